"""BSD texts are told apart, and the match of an MIT text covers its warranty paragraph."""

from tidemark.llm import licenses

INDEX = licenses.build_index(licenses.templates())


def found(text):
    return [(m["license"], m["start"], m["start"] + m["length"]) for m in licenses.scan(text, INDEX)]


def test_bsd_texts():
    two, three = licenses.templates()["BSD-2-Clause"], licenses.templates()["BSD-3-Clause"]
    for name, texts in (("BSD-2-Clause", two), ("BSD-3-Clause", three)):
        for text in texts:
            assert found(text) == [(name, 0, len(text) - 1)]
            assert [m[0] for m in found("Copyright (c) 2020, A. Writer. " + text.replace("binary form must", "binary forms must") + " More words follow.")] == [name]


def test_mit_whole_text():
    text = licenses.templates()["MIT"][-1]
    assert "WITHOUT WARRANTY" in text and found(text) == [("MIT", 0, len(text) - 1)]
