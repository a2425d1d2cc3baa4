"""Wikilinks: ground truth, removal, stripping of mentions, write-back."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalize

FOOTER = "%% wiki footer"


def zones(content: Column) -> Column:
    """Frontmatter, body and footer of a note; joined they are the note."""
    front = F.regexp_extract(content, r"(?s)\A(---.*?\n---)", 1)
    rest = F.substr(content, F.length(front) + 1)
    at = F.locate(FOOTER, content, 1) - F.length(front)
    body = F.when(at > 0, F.substr(rest, F.lit(1), at - 1)).otherwise(rest)
    footer = F.when(at > 0, F.substr(rest, at)).otherwise("")
    return F.struct(front.alias("front"), body.alias("body"), footer.alias("footer"))


def link_targets(content: Column) -> Column:
    """Normalised distinct targets of the links in the body; embeds, code and the footer don't count."""
    body = F.regexp_replace(F.regexp_replace(content, r"(?s)\A---\n.*?\n---\n?", ""), r"(?s)```.*?```", "")
    body = F.element_at(F.split(body, FOOTER, 2), 1)
    found = F.regexp_extract_all(body, F.lit(r"(!?\[\[[^\]]+\]\])"), F.lit(1))
    plain = F.filter(found, lambda x: ~x.startswith("!"))
    target = lambda x: normalize(F.regexp_extract(x, r"^\[\[([^\]|#]*)", 1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(plain, target), lambda t: t != "")))


def anchors(text: Column) -> Column:
    """Anchor texts of links: the display text, else the target; sections cut, blanks dropped."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]|]+(?:\|[^\[\]]+)?)\]\]"), F.lit(1))
    last = lambda x: F.trim(F.regexp_replace(F.element_at(F.split(x, r"\|"), -1), r"(?s)#.*$", ""))
    return F.filter(F.transform(found, last), lambda a: a != "")


def remove_aliased(content: Column) -> Column:
    """Links with a display text vanish from the body; embeds stay."""
    z = zones(content)
    return F.concat(z["front"], F.regexp_replace(z["body"], r"(?<!!)\[\[[^\]|]+\|[^\]]+\]\]", ""), z["footer"])


def strip_links(text: Column) -> Column:
    """Embeds vanish; links leave their display text, or their target without section."""
    out = F.regexp_replace(text, r"!\[\[[^\]]*\]\]", "")
    out = F.regexp_replace(out, r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1")
    out = F.regexp_replace(out, r"\[\[([^\]#]+)#[^\]]*\]\]", "$1")
    return F.regexp_replace(out, r"\[\[([^\]]+)\]\]", "$1")


def write_back(content: Column, phrase: Column, start: Column, end: Column, title: Column) -> Column:
    """(content, replaced, reason): one link put in place of a span, guarded against drift and nesting."""
    before, after = F.substr(content, F.lit(1), start), F.substr(content, end + 1)
    drift = F.substr(content, start + 1, end - start) != phrase
    line = F.regexp_extract(after, r"^([^\n]*)", 1)
    linked = before.endswith("[[") | after.startswith("]]") | (before.endswith("[") & line.startswith("]("))
    link = F.when(F.lower(F.trim(phrase)) == F.lower(F.trim(title)), F.concat(F.lit("[["), title, F.lit("]]"))).otherwise(F.concat(F.lit("[["), title, F.lit("|"), phrase, F.lit("]]")))
    reason = F.when(drift, "span-drift").when(linked, "already-linked")
    return F.struct(F.when(reason.isNull(), F.concat(before, link, after)).otherwise(content).alias("content"), reason.isNull().alias("replaced"), reason.alias("reason"))


def strip_mentions(notes: DataFrame, titles: DataFrame, content_col: str = "content", own_col: str = "basename") -> DataFrame:
    """notes whose bodies lose unlinked mentions of other notes' titles (whole words, any case, longest first).

    titles is one column of names; the list is sent to the executors, so it is checked to be at most 200,000
    (beyond that a note's own n-grams have to be joined with the titles instead, as in spans.title_mentions).
    """
    names = [r[0] for r in titles.select(titles.columns[0]).distinct().limit(200_001).collect() if r[0]]
    if len(names) > 200_000:
        raise ValueError("too many titles to send; join mentions instead")
    names.sort(key=lambda t: (-len(t), t))

    def run(content: pa.Array, own: pa.Array) -> pa.Array:
        import ahocorasick

        there = ahocorasick.Automaton()
        for rank, t in enumerate(names):
            there.add_word(t.lower(), rank)
        if names:
            there.make_automaton()

        def clean(text: str | None, mine: str | None) -> str | None:
            front = re.match(r"---.*?\n---", text or "", re.S)
            a = front.end() if front else 0
            z = (text or "").find(FOOTER, a)
            z = len(text or "") if z < 0 else z
            if not text or not names:
                return text
            links: list[str] = []

            def hide(m: re.Match) -> str:
                links.append(m[0])
                return f"\0LINK_{len(links) - 1}\0"

            body, rank = re.sub(r"\[\[[^\]]*\]\]", hide, text[a:z]), -1
            while left := {r for _, r in there.iter(body.lower()) if r > rank}:
                rank = min(left)  # removing one may bring another together, so look again
                if names[rank] != mine:
                    body = re.sub(rf"(?<![a-zA-Z0-9]){re.escape(names[rank])}(?![a-zA-Z0-9])", "", body, flags=re.I)
            return text[:a] + re.sub(r"\0LINK_(\d+)\0", lambda m: links[int(m[1])], body) + text[z:]

        return pa.array([clean(t, o) for t, o in zip(content.to_pylist(), own.to_pylist())], pa.string())

    return notes.withColumn(content_col, F.arrow_udf(run, "string")(content_col, own_col))
