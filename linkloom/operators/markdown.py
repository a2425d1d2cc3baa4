"""Markdown notes to sentences of tokens with offsets into the source, and the structural weight of each token.

The stripper is one compiled alternation matched at the current position: rules apply wherever the
scanner stands (a heading marker or a rule pair in mid-line counts too), the first that matches wins,
and what it keeps is mapped back to the source character by character.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# What weighs tokens, a bold span within a line or a heading line (its marks, then white space in the line).
BOLD = re.compile(r"\*\*.+?\*\*")
HEADING = re.compile(r"^(#{1,6})(?!#)[^\S\n]", re.M)
WORD = re.compile("[a-zA-Z0-9]+(?:['’][a-zA-Z]+)*")
# What is dropped, or kept in part (groups alias, plain, label), in order of priority.
RULE = re.compile(
    r"---\n.*?\n---\n?|```.*?```|`[^`\n]+`|!\[[^\]]*\]\([^)]*\)"
    r"|\[\[[^\]|]+\|(?P<alias>[^\]]+)\]\]|\[\[(?P<plain>[^\]]+)\]\]|\[(?P<label>[^\]]*)\]\([^)]*\)"
    r"|<[^>]+>|https?://[^\s)]+|#{1,6}\s|\*{1,3}|_{1,2}",
    re.S,
)

TOKEN_TYPE = "array<struct<lower:string,original:string,start:int,end:int,boost:int>>"


def structural_ranges(content: str) -> list[tuple[int, int, int]]:
    """(start, end, boost), by start: 3 for the first top heading, 2 for other headings, 1 for bold spans.

    A heading's text begins one character behind its marks and ends with the line of the marks.
    """
    bold = [(*m.span(), 1) for m in BOLD.finditer(content)]
    heads = [(m.end(1) + 1, _line_end(content, m.end(1)), len(m[1])) for m in HEADING.finditer(content)]
    title = next((h for h in heads if h[2] == 1), None)
    return sorted([*bold, *((a, z, 3 if (a, z, n) == title else 2) for a, z, n in heads)])


def _line_end(content: str, at: int) -> int:
    end = content.find("\n", at)
    return len(content) if end < 0 else end


def boost_of(start: int, end: int, ranges: list[tuple[int, int, int]]) -> int:
    return max((b for s, e, b in ranges if start < e and end > s), default=0)


def boosts_of(starts: list[int], ends: list[int], ranges: list[tuple[int, int, int]]) -> list[int]:
    """The largest boost of the ranges that each token, in order of place, overlaps; 0 if there is none."""
    out = [0] * len(starts)
    for a, z, boost in ranges:
        for i in range(bisect_right(ends, a), bisect_left(starts, z)):
            out[i] = max(out[i], boost)
    return out


def strip(content: str) -> tuple[str, list[int]]:
    """Plain text, and for each of its characters the offset in the source."""
    text, offsets, i = [], [], 0
    for m in RULE.finditer(content):
        text.append(content[i : m.start()])
        offsets += range(i, m.start())
        for name in ("alias", "plain", "label"):
            if m[name] is not None:
                # a display text equal to a part of its target is placed where it first occurs
                at = m.start() + m[0].index(m[name]) if name == "alias" else m.start(name)
                text.append(m[name])
                offsets += range(at, at + len(m[name]))
        i = m.end()
    text.append(content[i:])
    offsets += range(i, len(content))
    return "".join(text), offsets


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the trimmed sentences."""
    out, last = [], 0
    cuts = [(m.start() if m[0].startswith("\n") else m.start() + 1, m.end()) for m in re.finditer(r"[.!?](?=\s|$)|\n\n", text)]
    for end, nxt in [*cuts, (len(text), len(text))]:
        piece = text[last:end]
        a = last + len(piece) - len(piece.lstrip())
        z = last + len(piece.rstrip())
        if z > a:
            out.append((a, z))
        last = nxt
    return out


def word_lists(content: str | None, markdown: bool = True, places: bool = True) -> list[tuple[int, list[str], list[int], list[int]]]:
    """(index, words, starts, ends) of each sentence, offsets into the source; without markdown the text is
    taken as it is, without places the offsets are left out."""
    content = content or ""
    text, offsets = strip(content) if markdown else (content, None)
    out = []
    for i, (a, z) in enumerate(sentence_spans(text)):
        starts, ends = [], []
        if places:
            for m in WORD.finditer(text, a, z):
                x, y = m.span()
                starts.append(x)
                ends.append(y)
            if offsets is not None:
                starts, ends = [offsets[x] for x in starts], [offsets[y - 1] + 1 for y in ends]
        out.append((i, WORD.findall(text, a, z), starts, ends))
    return out


def weighed_words(content: str | None, markdown: bool = True) -> list[tuple[int, list[str], list[int], list[int], list[int]]]:
    """word_lists with the boosts of the words."""
    ranges = structural_ranges(content or "") if markdown else []
    return [(i, words, starts, ends, boosts_of(starts, ends, ranges)) for i, words, starts, ends in word_lists(content, markdown)]


def preprocess(content: str | None, markdown: bool = True) -> list[dict]:
    """Sentences with tokens (lower, original, start, end, boost)."""
    token = lambda w, s, e, b: {"lower": w.lower(), "original": w, "start": s, "end": e, "boost": b}
    return [{"sent_idx": i, "tokens": list(map(token, *columns))} for i, *columns in weighed_words(content, markdown)]


def text_slices(batches, column: str = "text", limit: int = 1 << 20):
    """Record batches cut so that the texts of a slice are about `limit` bytes, or one text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        a = 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + limit, "right")))
            yield batch.slice(a, z - a)
            a = z


def strip_column(content: Column | str) -> Column:
    """Plain text of Markdown, in Arrow batches."""
    def run(c: pa.Array) -> pa.Array:
        return pa.array([None if x is None else strip(x)[0] for x in c.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(content)


def note_sentences(notes: DataFrame, id_col: str = "note_id", content_col: str = "content", markdown: bool = True) -> DataFrame:
    """(note_id, sent_idx, tokens) of Markdown notes (or of plain text); a task holds the tokens of about 1 MB of text."""
    kind = dict(notes.dtypes)[id_col]

    def run(batches):
        for b in text_slices(batches):
            at, where, sizes, columns = [], [], [0], [[] for _ in range(4)]
            for k, text in enumerate(b.column("text").to_pylist()):
                for i, *found in weighed_words(text, markdown):
                    at.append(k)
                    where.append(i)
                    sizes.append(len(found[0]))
                    for c, f in zip(columns, found):
                        c += f
            words, *numbers = columns
            token = pa.StructArray.from_arrays([pa.array([w.lower() for w in words], pa.string()), pa.array(words, pa.string()), *(pa.array(n, pa.int32()) for n in numbers)], names=["lower", "original", "start", "end", "boost"])
            tokens = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), token)
            yield pa.RecordBatch.from_arrays([b.column("note_id").take(pa.array(at, pa.int64())), pa.array(where, pa.int32()), tokens], names=["note_id", "sent_idx", "tokens"])

    return notes.select(F.col(id_col).alias("note_id"), F.col(content_col).cast("string").alias("text")).mapInArrow(run, f"note_id {kind}, sent_idx int, tokens {TOKEN_TYPE}")


def plain_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same of plain text, without Python: no Markdown rules and no offsets."""
    from ..functions.text import sentences, tokens

    rows = docs.select(F.col(id_col).alias("note_id"), F.posexplode(sentences(F.col(text_col))).alias("sent_idx", "sentence"))
    token = lambda t: F.struct(F.lower(t).alias("lower"), t.alias("original"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(0).alias("boost"))
    return rows.select("note_id", "sent_idx", F.transform(tokens(F.col("sentence")), token).alias("tokens"))
