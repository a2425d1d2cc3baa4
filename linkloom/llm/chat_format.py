"""Chat formatting over typed content parts.

A message is an ordered list of parts (text, image, audio, document). A visitor flattens it: text is
escaped and copied, every other part becomes a placeholder in its place and a row among the attachments
(kind, reference, tokens that the placeholder will expand to). The template frames each turn as

    <|im_start|>ROLE\n CONTENT <|im_end|>\n

and escapes what looks like a control string inside roles and texts: every "<" that is followed by any
number of backslashes and a "|" gets one backslash more behind it. Unescaping takes one away, so any
text returns unchanged, and no escaped text holds "<|". The loss mask is the spans of the output that
hold the content of assistant turns, framing excluded.

A conversation is brought together by its id and sorted by turn, then streamed: the task holds one
batch and a running digest, never a whole conversation, however long.

Typed content comes as a JSON list of parts. What isn't one (broken JSON, another value) is one text part as it
stands; a part of an unknown kind, or a text part whose text is no string, is kept as the text of its JSON; a
reference that is no string is written as JSON, a token count that is no whole number from 0 on is the kind's own.

Defined cases: null text is empty; null roles are empty, and line breaks (and percent signs) in a role are written
as %0A (and %25); a null conversation id is one conversation of
its own; rows that repeat a turn follow each other, ordered by role and text; an empty table gives only
the rows that the caller adds.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from .common import byte_batches

START, END = "<|im_start|>", "<|im_end|>"
ESCAPE, UNESCAPE = re.compile(r"<(?=\\*\|)"), re.compile(r"<\\(?=\\*\|)")
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
#: Tokens that a placeholder of each kind expands to if the part doesn't say.
PART_TOKENS = {"image": 256, "audio": 128, "document": 512}


def escape(text: str) -> str:
    return ESCAPE.sub(r"<\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub("<", text)


@dataclass
class Flat:
    """What a visitor has gathered of one message."""

    text: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int]] = field(default_factory=list)


class Visitor:
    """Flattens typed parts in order; what it can't read is kept as escaped JSON text."""

    def visit(self, parts) -> Flat:
        out = Flat()
        for part in parts or ():
            kind = part.get("type") if isinstance(part, dict) else "text" if isinstance(part, str) else None
            visitors = {"text": self.visit_text, **dict.fromkeys(PART_TOKENS, self.visit_attachment)}
            (visitors.get(kind, self.visit_other) if isinstance(kind, str) else self.visit_other)(part, out)
        return out

    def visit_text(self, part, out: Flat) -> None:
        text = part if isinstance(part, str) else part.get("text")
        if text is None or isinstance(text, str):
            out.text.append(escape(text or ""))
        else:
            self.visit_other(part, out)

    def visit_attachment(self, part, out: Flat) -> None:
        kind, ref, n = part["type"], part.get("ref"), part.get("tokens")
        ref = ref if isinstance(ref, str) else "" if ref is None else json.dumps(ref, ensure_ascii=False, sort_keys=True)
        whole = isinstance(n, int) and not isinstance(n, bool) and 0 <= n < 1 << 31
        out.attachments.append((kind, ref, n if whole else PART_TOKENS[kind]))
        out.text.append(f"<|{kind}_{len(out.attachments) - 1}|>")

    def visit_other(self, part, out: Flat) -> None:
        out.text.append(escape(json.dumps(part, ensure_ascii=False, sort_keys=True)))


def read_parts(content: str | None) -> list:
    """The parts of a JSON list; anything else is one text part."""
    try:
        got = json.loads(content) if content else []
    except (ValueError, RecursionError):
        return [content]
    return got if isinstance(got, list) else [content]


def format_turn(role: str | None, content) -> tuple[str, int, int, Flat]:
    """Formatted turn, the span of its content in it, and what was flattened; content: text or typed parts."""
    flat = Visitor().visit([content or ""] if content is None or isinstance(content, str) else content)
    named = escape(role or "").replace("%", "%25").replace("\n", "%0A")
    head = f"{START}{named}\n"
    body = "".join(flat.text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body), flat


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, content) of each turn, read back from the output."""
    return [(unescape(r.replace("%0A", "\n").replace("%25", "%")), unescape(c)) for r, c in TURN.findall(formatted)]


def _turns(parts: bool):
    def run(batches):
        import pyarrow as pa

        for b in byte_batches(batches, "text"):
            out, at = [], []
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist()):
                s, a, z, flat = format_turn(role, read_parts(text) if parts else text)
                out.append((s, a if role == "assistant" else 0, z if role == "assistant" else 0, sum(x[2] for x in flat.attachments)))
                at.append([{"kind": k, "ref": r, "tokens": n} for k, r, n in flat.attachments])
            cols = list(zip(*out)) or [[]] * 4
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))
            arrays = [b.column("conv_id"), b.column("turn"), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64()))), pa.array(at, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "formatted", "loss_from", "loss_to", "attached_tokens", "attachments"])

    return run


def format_turns(rows: DataFrame, parts: bool = False) -> DataFrame:
    """Every row formatted where it is; text is plain, or with parts a JSON list of typed parts."""
    cols = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return cols.mapInArrow(_turns(parts), "conv_id long, turn long, formatted string, loss_from int, loss_to int, attached_tokens long, attachments array<struct<kind:string,ref:string,tokens:int>>")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attached_tokens long"


def _read_back(batches):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())

    def emit(rows):
        names = [c.split(" ")[0] for c in DIGESTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    def closed(s):
        return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), *s[5:]]

    state = None
    for b in byte_batches(batches, "formatted"):
        out = []
        for conv, text, a, z, n, tokens in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to", "n_attachments", "attached_tokens"))):
            if state is None or state[0] != conv:
                if state is not None:
                    out.append(closed(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, content in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
            masked = unescape(text[a:z])
            state[3] += len(masked)
            state[4].update(masked.encode("utf-8", "surrogatepass"))
            state[5] += len(text)
            state[6] += n
            state[7] += tokens
        if out:
            yield emit(out)
    if state is not None:
        yield emit([closed(state)])


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted turns."""
    cols = turns.select("conv_id", "turn", "formatted", "loss_from", "loss_to", F.size("attachments").cast("long").alias("n_attachments"), "attached_tokens")
    return cols.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(_read_back, DIGESTS)
