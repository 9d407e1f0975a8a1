from sojourn.llm import licenses


def found(spark, rows):
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    return {r["doc_id"]: r["license"] for r in licenses.licensed_lines(files).collect()}


def test_wrapped_and_long(spark):
    """Notices over several lines, in the middle of a paragraph, behind comment signs, and whole licence texts."""
    texts = dict(reversed(licenses.FULL_TEXTS))
    wrap = lambda t, k, sign="": "\n".join(sign + " ".join(t.split()[i : i + k]) for i in range(0, len(t.split()), k))
    prose = "The harbour was calm that evening and nobody spoke of the storm that had come over the hills. "
    code = "\n".join(f"let x{i} be the harbour of {i}" for i in range(200))
    gpl = next(t for n, t in licenses.FULL_TEXTS if n == "GPL-3.0" and "Preamble" in t)
    rows = [
        (0, "a/x.txt", "Some title\nThis work is licensed under the GNU General\nPublic License, version 3.\n" + prose),
        (1, "a/y.txt", prose * 3 + "Released under the MIT License. " + prose * 3),
        (2, "a/LICENSE", "Copyright (c) 2001 Some Body\n\n" + wrap(texts["MIT"], 9)),
        (3, "a/LICENSE", "Copyright (c) 2001 Some Body. All rights reserved.\n\n" + wrap(texts["BSD-2-Clause"], 9)),
        (4, "a/COPYING", "Copyright (c) 2001 Some Body. All rights reserved.\n" + wrap(texts["BSD-3-Clause"], 12)),
        (5, "a/z.c", wrap(texts["Apache-2.0"], 8, "# ") + "\n\n" + code),
        (6, "a/COPYING", wrap(gpl, 11) + "\n" + "\n".join(f"section {i} says what one may do" for i in range(300))),
        (7, "a/w.txt", prose + "\nAll rights reserved.\n" + prose),
        (8, "a/v.txt", "All rights reserved.\nReleased under the MIT License"),
        (9, "a/u.txt", prose * 5),
        (10, "a/LICENSE", texts["ISC"]),
    ] + [(100 + i, "b/p.txt", prose) for i in range(40)]
    want = {0: "GPL-3.0", 1: "MIT", 2: "MIT", 3: "BSD-2-Clause", 4: "BSD-3-Clause", 5: "Apache-2.0", 6: "GPL-3.0", 7: "Proprietary", 8: "MIT", 10: "ISC"}
    assert found(spark, rows) == want


def test_reserved_rights_do_not_inherit(spark):
    rows = [(1, "r/LICENSE", "Released under the MIT License"), (2, "r/a.txt", "Prose\nAll rights reserved."), (3, "r/b.txt", "Prose")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert {r["doc_id"]: (r["license"], r["distance"]) for r in got} == {1: ("MIT", None), 2: ("Proprietary", None), 3: ("MIT", 0)}
