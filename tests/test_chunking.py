from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.operators.chunking import chunk_text, chunks, fences, tokens

WORDS = " ".join(f"w{i}" for i in range(120))


def test_blank_and_short():
    assert chunk_text(None) == chunk_text("  \n") == []
    only = chunk_text("hello world")
    assert [(c["heading"], c["char_start"], c["char_end"]) for c in only] == [("(no heading)", 0, 11)]


def test_sections_and_tiny_merge():
    text = f"intro words here\n# A\n# B\n{WORDS}\n## C\n{WORDS}"
    found = chunk_text(text)
    assert [c["heading"] for c in found] == ["B", "C"]
    assert found[0]["char_start"] == 0 and found[0]["text"].startswith("intro words here\n\n# A\n\n# B")
    assert [c["chunk_index"] for c in found] == [0, 1]


def test_preamble_kept_when_long():
    assert [c["heading"] for c in chunk_text(f"{WORDS}\n# A\n{WORDS}")] == ["(preamble)", "A"]


def test_overlap_and_limit():
    text = "\n\n".join(f"{WORDS} p{i}" for i in range(6))
    found = chunk_text(text)
    assert len(found) > 2
    for a, b in zip(found, found[1:]):
        assert b["char_start"] == a["char_end"] - 342
        assert b["text"].startswith(a["text"][-300:][:10]) or a["text"][-342:] in b["text"]
    assert found[-1]["char_end"] == len(text)


def test_fences_are_not_cut():
    code = "```\n" + "\n\n".join(WORDS for _ in range(4)) + "\n```"
    assert any(code in c["text"] for c in chunk_text(f"{WORDS}\n\n{code}\n\n{WORDS}"))
    assert fences("a\n```\nb") == [(2, 7)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "two words.", "# Head", "## Sub part", "\n", "```", WORDS, ". "]), max_size=25))
def test_spans_stay_inside(parts):
    text = "\n".join(parts)
    for c in chunk_text(text, 64):
        assert 0 <= c["char_start"] <= c["char_end"] and c["text"].strip() == c["text"] != ""
        assert tokens(c["text"]) <= c["token_count"] or c["token_count"] >= 0


def test_frame(spark):
    docs = spark.createDataFrame([("a.md", f"# H\n{WORDS}"), ("b.md", None)], "doc_path string, text string")
    row = chunks(docs).first()
    assert row["heading"] == "H" and len(row["content_hash"]) == 64
