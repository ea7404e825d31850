"""Checks of specifications, and of plans against the specifications of their tests. A document is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import normalized
from skein.sources.parsers import front_matter
from skein.sources.storage import dealt

c = F.col
# Front matter that specifications need.
SPEC_KEYS = ("spec_version", "project", "component", "language", "status")
TEST_KEYS = ("tests_version", "spec_ref", "component")
TEST_SECTIONS = ("Unit Tests", "Integration Tests", "E2E Tests")


def section_lines(text: Column, heading: str) -> Column:
    """The trimmed lines below the first `## heading`, in any case, up to the next heading of two levels; none if it lacks."""
    body = F.regexp_extract(text, rf"(?ims)^[ \t]*## [ \t]*{heading}[ \t\r]*$(.*?)(?:^[ \t]*## |\z)", 1)
    return F.transform(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))


def table_lines(text: Column, heading: str) -> Column:
    """Lines of the section's tables, header first, without those that only separate."""
    return F.filter(section_lines(text, heading), lambda x: x.startswith("|") & (F.translate(x, "|-: ", "") != ""))


def first_cells(text: Column, heading: str) -> Column:
    """The first cell of each row below the header, where it isn't empty."""
    return F.filter(F.transform(F.slice(table_lines(text, heading), 2, 1 << 20), lambda x: F.trim(F.regexp_extract(x, r"^\|+([^|]*)", 1))), lambda x: x != "")


def test_names(text: Column, heading: str) -> Column:
    return F.filter(F.transform(section_lines(text, heading), lambda x: F.trim(F.regexp_extract(x, "^### Test:(.*)$", 1))), lambda x: x != "")


def has_entries(text: Column, heading: str) -> Column:
    """Whether the section has a row below a header, an item or a heading of three levels."""
    return (F.size(table_lines(text, heading)) >= 2) | F.exists(section_lines(text, heading), lambda x: x.startswith("- ") | x.startswith("### "))


def _findings(docs: DataFrame, key: str, checks: list[tuple[Column, str, Column | str]]) -> DataFrame:
    rows = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), (F.lit(x) if isinstance(x, str) else x).alias("finding"))) for when, severity, x in checks]
    return docs.select(key, F.inline(F.array_compact(F.array(*rows))))


def _opened(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, front, none): the text, null as empty, its front matter, found once for all checks, and whether it has none; dealt over all cores."""
    own = dealt(docs.select(key, F.coalesce(c(text), F.lit("")).alias("_text")), key)
    none = ~c("_text").rlike(r"^---\r?\n(?s:.*?)\n---")
    return own.withColumns({"_front": front_matter(F.replace("_text", F.lit("\r\n"), F.lit("\n"))), "_none": none})


def _front_checks(keys: tuple[str, ...]) -> list[tuple[Column, str, str]]:
    return [(c("_none"), "error", "front_matter_missing"), *[(~c("_none") & F.try_element_at("_front", F.lit(k)).isNull(), "error", f"key_missing:{k}") for k in keys]]


def spec_findings(specs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, severity, finding) of what a specification lacks: front matter and its keys, sections, code blocks. A null text lacks all of it."""
    t = c("_text")
    lacks = lambda heading: ~t.contains(f"## {heading}")
    checks = [(lacks(h), severity, f"section_missing:{h}") for h, severity in (("Types", "warning"), ("Interfaces", "warning"), ("Implementations", "error"), ("Acceptance", "error"))]
    return _findings(_opened(specs, key, text), key, [*_front_checks(SPEC_KEYS), *checks, (F.regexp_count(t, F.lit("```")) < 4, "warning", "few_code_blocks")])


def test_spec_findings(specs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, severity, finding) of what a specification of tests lacks, by its category: `ops` needs smoke tests, `content` a checklist, others
    unit or integration tests, edge cases, and what their surface asks for."""
    t, front = c("_text"), c("_front")
    category, surface = c("_category"), c("_surface")
    opened = _opened(specs, key, text).withColumns({"_category": F.try_element_at(front, F.lit("category")), "_surface": F.try_element_at(front, F.lit("surface"))})
    kind = F.coalesce(category, F.lit("code"))
    code, lacks = ~kind.isin("ops", "content"), lambda heading: ~t.contains(f"## {heading}")
    user = surface.isin("ui", "api", "cli", "user-facing")
    return _findings(opened, key, [
        *_front_checks(TEST_KEYS),
        (category.isNull(), "warning", "key_missing:category"),
        ((kind == "ops") & lacks("Smoke Tests"), "error", "section_missing:Smoke Tests"),
        ((kind == "ops") & ~has_entries(t, "Edge Cases"), "warning", "section_empty:Edge Cases"),
        ((kind == "content") & lacks("Deliverable Checklist"), "error", "section_missing:Deliverable Checklist"),
        (code & lacks("Unit Tests") & lacks("Integration Tests"), "error", "section_missing:Unit Tests"),
        (code & ~has_entries(t, "Edge Cases"), "error", "section_empty:Edge Cases"),
        (code & user & ~has_entries(t, "E2E Tests"), "error", "section_empty:E2E Tests"),
        (code & (surface == "ui") & ~has_entries(t, "Visual Verification"), "error", "section_empty:Visual Verification"),
        (code & (surface == "user-facing"), "warning", "surface_deprecated"),
        (code & surface.isNotNull() & ~user & (surface != "internal"), "warning", F.concat(F.lit("surface_unknown:"), surface)),
        (code & surface.isNull(), "warning", "key_missing:surface"),
    ])


def coverage_findings(plans: DataFrame, key: str, spec: str, tasks: str) -> DataFrame:
    """(key, severity, finding) of what of its tests' specification a plan doesn't carry.

    `tasks` is an array of (id, name, type, edge_cases array, test_cases array, ui). An edge case is carried by tasks of which a case holds its text,
    white space and case aside; where tasks have types, a test and an implementation must. Rows that begin with `none` waive. A null spec asks for nothing.
    """
    t, own = F.coalesce(c(spec), F.lit("")), F.coalesce(c(tasks), F.expr("array()"))
    typed = F.exists(own, lambda x: x["type"].isNotNull())
    tests = lambda x: F.coalesce(x["type"].isin("test", "e2e"), F.lit(False))
    carriers = lambda case: F.filter(own, lambda x: F.coalesce(F.exists(x["edge_cases"], lambda e: F.contains(normalized(e), normalized(case))), F.lit(False)))
    finding = lambda severity, name, what: F.struct(F.lit(severity).alias("severity"), F.concat(F.lit(name), what).alias("finding"))

    def of_case(case: Column) -> Column:
        found = carriers(case)
        return F.array_compact(F.array(
            F.when(F.size(found) == 0, finding("error", "edge_case_missing:", case)),
            F.when((F.size(found) > 0) & typed & ~F.exists(found, tests), finding("error", "edge_case_without_test:", case)),
            F.when((F.size(found) > 0) & typed & F.forall(found, tests), finding("error", "edge_case_without_implementation:", case)),
            F.when((F.size(found) == 1) & ~typed, finding("warning", "edge_case_in_one_task:", case)),
        ))

    cases = F.filter(first_cells(t, "Edge Cases"), lambda x: ~normalized(x).startswith("none"))
    has_test = lambda name: F.exists(own, lambda x: F.coalesce(F.exists(x["test_cases"], lambda e: normalized(e) == normalized(name)), F.lit(False)))
    missing_in = lambda h: F.transform(F.filter(test_names(t, h), lambda n: ~has_test(n)), lambda n: finding("error", f"test_missing:{h}:", n))
    named = F.exists(own, lambda x: F.coalesce(normalized(x["id"]).contains("e2e"), F.lit(False)) | F.coalesce(normalized(x["name"]).contains("e2e"), F.lit(False)))
    e2e = F.when(typed, F.exists(own, lambda x: F.coalesce(x["type"] == "e2e", F.lit(False)))).otherwise(named)
    surface = F.try_element_at(front_matter(F.replace(t, F.lit("\r\n"), F.lit("\n"))), F.lit("surface"))
    rest = F.array_compact(F.array(
        F.when((F.size(test_names(t, "E2E Tests")) > 0) & ~e2e, finding("error", "task_missing:", F.lit("e2e"))),
        F.when((surface == "ui") & ~F.exists(own, lambda x: F.coalesce(x["ui"], F.lit(False))), finding("error", "task_missing:", F.lit("ui"))),
    ))
    return plans.select(key, F.inline(F.concat(F.flatten(F.transform(cases, of_case)), *[missing_in(h) for h in TEST_SECTIONS], rest)))
