import re

import pytest
from hypothesis import given, strategies as st

from linkloom.operators import markdown as md

CASES = [
    ("---\ntitle: x\n---\nBody", "Body"),
    ("see [[Target]] now", "see Target now"),
    ("see [[Target|shown]] now", "see shown now"),
    ("a [text](http://x.y) b", "a text b"),
    ("a ![alt](p.png) b", "a  b"),
    ("a\n```\ncode\n```\nb", "a\n\nb"),
    ("run `ls` now", "run  now"),
    ("# Head", "Head"),
    ("**bold** and _it_", "bold and it"),
    ("go http://a.b/c now", "go  now"),
    ("a <b>c</b>", "a c"),
    ("C# is snake_case", "Cis snakecase"),
]


@pytest.mark.parametrize("source,want", CASES)
def test_strip(source, want):
    text, offsets = md.strip(source)
    assert text == want
    assert all(source[o] == c for o, c in zip(offsets, text))


def test_structural_ranges():
    text = "# A\n## B\n# C **d**"
    assert [b for _, _, b in md.structural_ranges(text)] == [3, 2, 2, 1]
    assert md.boost_of(2, 3, md.structural_ranges(text)) == 3


def test_sentences_and_tokens():
    s = md.preprocess("# Title\n\nFirst one. Don't stop\nhere!  Last")
    assert [[t["lower"] for t in x["tokens"]] for x in s] == [["title"], ["first", "one"], ["don't", "stop", "here"], ["last"]]
    assert s[0]["tokens"][0]["boost"] == 3


@given(st.text(alphabet="ab. !?\n\t", max_size=40))
def test_sentence_spans_equal_split(text):
    want = [p.strip() for p in re.split(r"(?<=[.!?])(?=\s)|\n\n", text)]
    assert [text[a:z] for a, z in md.sentence_spans(text)] == [w for w in want if w]


@given(st.text(alphabet="ab #*_[]|`\n-<>!().", max_size=60))
def test_offsets_point_to_kept_characters(text):
    out, offsets = md.strip(text)
    assert len(out) == len(offsets) and all(text[o] == c for o, c in zip(offsets, out))


def test_spark_forms(spark):
    notes = spark.createDataFrame([(1, "# A\n\nplain text here. More"), (2, None), (3, "")], "note_id int, content string")
    rows = {(r.note_id, r.sent_idx): [t["lower"] for t in r.tokens] for r in md.note_sentences(notes).collect()}
    assert rows == {(1, 0): ["a"], (1, 1): ["plain", "text", "here"], (1, 2): ["more"]}
    assert [r[0] for r in notes.select(md.strip_column("content")).collect()] == ["A\n\nplain text here. More", None, ""]


def test_sentences_come_in_slices_and_boosts_equal_the_single_ones(spark):
    """A batch of many notes isn't held as objects; tokens of long notes are weighed range by range."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 40, None, "b" * 40, "c" * 500, "", "d"])], names=["text"])
    cut = list(md.text_slices([batch, batch.slice(0, 0)], limit=80))
    assert [b.num_rows for b in cut] == [3, 1, 2] and pa.Table.from_batches(cut).to_pylist() == batch.to_pylist()
    text = "# A **b c** d\ne **f** g\n## h **i\nj** [[k|l m]] **n**"
    ranges = md.structural_ranges(text)
    for _, words, starts, ends, boosts in md.weighed_words(text):
        assert boosts == [md.boost_of(a, z, ranges) for a, z in zip(starts, ends)] and len(set(boosts)) > 2
