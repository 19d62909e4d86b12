import pyarrow as pa

from siteloom.llm import licenses


def found(text):
    return licenses.scan_texts(pa.array([text]), licenses.Templates(licenses.TEMPLATES))[0]


def test_units():
    prose = "Some words about nothing at all. "
    assert found(prose * 20) == {}
    assert found(prose + "Released under the MIT License. " + prose)["MIT"][0] == 1.0
    assert found(prose + "\nlicensed under the apache license version 2.0\n" + prose)["Apache-2.0"][:2] == (1.0, 1)
    spread = next(t for n, t in licenses.TEMPLATES if n == "ISC").replace("and", "\n")
    assert set(found(prose + "\n\n" + spread + "\n\n" + prose)) == {"ISC"}
    assert set(found("Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.")) >= {"CC-BY-NC-4.0", "CC-BY-4.0"}


def best(text):
    return min(found(text).items(), key=lambda x: (-x[1][2], -x[1][0], x[0]))[0]


def test_whole_texts_however_they_are_laid_out():
    by = {n: t for n, t in licenses.TEMPLATES if len(t) > 400}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "GPL-3.0-or-later", "Apache-2.0"} <= set(by)
    for name, text in by.items():
        words = text.split()
        lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        assert best("/*\n * Copyright (c) 2020 Jane Doe\n *\n" + "".join(f" * {x}\n" for x in lines) + " */\nint main() { return 0; }\n" * 20) == name
        assert best("Copyright 1999 X\n\n" + "\n\n".join("# " + x for x in lines) + "\n\nvoid f();") == name
    assert best("We like it. This project is licensed under the terms\nof the MIT license. And so on with more words.") == "MIT"
    assert found("to be or not to be, in the end of the software of the world") == {}


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "Released under the MIT License.", "x"), (3, "x", "x"), (3, "x", "x"), (4, "Released under the MIT License.\n" * 30000, "x")]
    got = licenses.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert [(r["doc_id"], r["license"], r["n_units"] > 0) for r in got] == [(1, None, False), (2, None, False), (None, "MIT", True), (3, None, False), (3, None, False), (4, "MIT", True)]
