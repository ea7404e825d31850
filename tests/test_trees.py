"""Ignore rules of a tree, and repaired paths."""

import random
import re

from pyspark.sql import functions as F

from skein.operators.paths import repaired
from skein.sources.ignores import ignored_paths, kept_files, rules


def translated(pattern):
    """A pattern's regular expression, letter by letter."""
    body, i = "", 0
    text = pattern[1:] if pattern.startswith("/") else pattern
    while i < len(text):
        if (i == 0 or text[i - 1] == "/") and text.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif text[i:] == "**" and i and text[i - 1] == "/":
            body, i = body + ".+", len(text)
        elif text[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif text[i] == "?":
            body, i = body + "[^/]", i + 1
        elif text[i] == "[":
            end = text.index("]", i)
            body, i = body + "[" + text[i + 1 : end].replace("!", "^") + "]", end + 1
        elif text[i] == "\\":
            body, i = body + re.escape(text[i + 1]), i + 2
        else:
            body, i = body + re.escape(text[i]), i + 1
    return ("" if "/" in pattern else "(?:.*/)?") + body


def brute(files):
    kinds = [".gitignore", ".ignore", ".memoryignore"]

    def one(path, is_folder):
        best = None
        for name, text in files.items():
            folder, _, leaf = name.rpartition("/")
            if leaf not in kinds or not (folder == "" or path.startswith(folder + "/")):
                continue
            for n, line in enumerate(text.split("\n")):
                line = re.sub(r"(?<!\\)[ \t]+$", "", line)
                if not line or line.startswith("#"):
                    continue
                negated, bare = line.startswith("!"), line.removeprefix("!")
                if bare.endswith("/") and not is_folder:
                    continue
                relative = path[len(folder) + 1 :] if folder else path
                if re.fullmatch(translated(bare.removesuffix("/")), relative):
                    best = max(best or ((-1,), False), ((kinds.index(leaf), folder.count("/") + bool(folder), n), negated))
        return best is not None and not best[1]

    out = set()
    for path in files:
        parts = path.split("/")
        if any(one("/".join(parts[:k]), k < len(parts)) for k in range(1, len(parts) + 1)):
            out.add(path)
    return out


def test_rules_equal_brute_force(spark):
    rnd = random.Random(7)
    names = ["a", "b", "src", "build", "x.log", "y.rs", "keep.log", "a.b", "[z]", "z", "w?"]
    patterns = ["*.log", "!keep.log", "build/", "/a", "src/*.rs", "**/b", "a/**", "**/src/z", "a.b", "!a/b", "?", "[!a]", "[ab]", "\\[z\\]", "w\\?", "# no", "", "x.log  ", "a/**/z", "b/", "!build/", "*"]
    for _ in range(6):
        files = {"/".join(rnd.choice(names[:4]) for _ in range(rnd.randint(0, 3))) + "/" + rnd.choice(names[4:]): "x" for _ in range(60)}
        files = {k.lstrip("/"): v for k, v in files.items()}
        for folder in ("", "a/", "src/", "a/b/"):
            files[folder + rnd.choice([".gitignore", ".ignore", ".memoryignore"])] = "\n".join(rnd.sample(patterns[:-1], 4) + ["*"] * (rnd.random() < 0.2))
        table = spark.createDataFrame(files.items(), "path string, text string")
        assert {r.path for r in ignored_paths(table, rules(table)).collect()} == brute(files)


def test_an_ignored_folder_is_not_entered_again(spark):
    files = {".gitignore": "out/\n*.tmp", "out/.gitignore": "!*", "out/x": "", "sub/.ignore": "!k.tmp", "sub/k.tmp": "", "sub/l.tmp": "", "y": ""}
    kept = kept_files(spark.createDataFrame(files.items(), "path string, text string"))
    assert sorted(r.path for r in kept.collect()) == ["sub/k.tmp", "y"]
    assert kept_files(spark.createDataFrame([], "path string, text string")).collect() == []


def test_repaired_paths(spark):
    index = spark.createDataFrame([(p,) for p in ("src/auth/mod.rs", "src/store/mod.rs", "src/main.rs", "web/view.ts", "README.md")], "path string")
    cases = {
        "src/main.rs": ("/ws/src/main.rs", "relative→absolute"),
        "main.rs": ("/ws/src/main.rs", "relative+fuzzy:main.rs→src/main.rs"),
        "ain.rs": ("/ws/src/main.rs", "relative+fuzzy:ain.rs→src/main.rs"),
        "auth/mod.rs:3-9": ("/ws/src/auth/mod.rs:3-9", "relative+fuzzy:auth/mod.rs→src/auth/mod.rs"),
        "mod.rs": ("/ws/mod.rs", "relative→absolute(new file)"),
        "lib/view.ts": ("/ws/web/view.ts", "relative+fuzzy:lib/view.ts→web/view.ts"),
        "new/file.rs": ("/ws/new/file.rs", "relative→absolute(new file)"),
        "/ws/src/main.rs": None,
        "/ws/lib/view.ts": ("/ws/web/view.ts", "fuzzy:lib/view.ts→web/view.ts"),
        "/elsewhere/view.ts:1-2": ("/ws/web/view.ts:1-2", "fuzzy_filename:view.ts→web/view.ts"),
        "/elsewhere/mod.rs": None,
        "/elsewhere/README.md": None,  # a path of the index as it stands
        "/wsx/src/main.rs": ("/ws/src/main.rs", "fuzzy_filename:main.rs→src/main.rs"),
    }
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(cases)], "task int, path string")
    got = {r.path: (r.new, r.reason) for r in repaired(rows, index, "/ws").collect()}
    assert got == {k: v for k, v in cases.items() if v}
    assert repaired(rows, index.limit(0), "/ws").filter(F.col("path").startswith("/")).collect() == []
