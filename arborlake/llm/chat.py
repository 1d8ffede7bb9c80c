"""Chat formatting with typed content parts.

A message's content is an ordered list of typed parts: text, image, audio or document. A visitor
flattens them into one string: text parts are escaped, the others become placeholders numbered by turn and
place among the turn's, as in ``<|image_3.1|>``, so that they are distinct in a conversation; each is
recorded as an attachment (kind, name of the placeholder, reference, place, and the tokens it expands to). The template marks
turns by ``<|im_start|>role``, a newline, the content, ``<|im_end|>`` and a newline. Any ``<``,
backslashes, ``|`` in a text or a role gets one backslash more, so no marker or placeholder can occur
in it, and taking that backslash away again gives the text back exactly.

A conversation is kept as one row per turn, in order; its formatted string is the concatenation. So
a conversation of any length is formatted in parallel, and is read back as a stream over sorted rows
with incremental digests: no task holds a whole conversation.

Defined results: null text is empty, a null role is the empty role, null parts are left out; a null
conv_id is a conversation of its own; a null turn comes first and has no number; rows that tie on turn go by role, then
escaped text, and repeated rows each count as a turn; a newline in a role is written ``<|nl|>``; an unknown part type fails with ValueError; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.textops import table, text_of

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
PATCH, MERGE, AUDIO_RATE, PAGE_TOKENS = 14, 2, 25, 512
PART = "type string, text string, ref string, width int, height int, seconds double, pages int"
FORMATTED = "conv_id long, turn long, role string, formatted string, loss_from long, loss_to long, attachments array<struct<kind:string,name:string,ref:string,place:long,tokens:long>>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


class PartVisitor:
    """Visits the parts of one message in order; out, attachments and tokens hold what it made."""

    def __init__(self, turn: int | str = ""):
        self.out: list[str] = []
        self.attachments: list[dict] = []
        self.length, self.turn = 0, turn

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part.get('type')}", None)
        if method is None:
            raise ValueError(f"unknown part type {part.get('type')!r}")
        method(part)

    def _put(self, s: str) -> None:
        self.out.append(s)
        self.length += len(s)

    def _attach(self, part: dict, kind: str, tokens: int) -> None:
        name = f"<|{kind}_{self.turn}.{len(self.attachments) + 1}|>"
        self.attachments.append({"kind": kind, "name": name, "ref": part.get("ref"), "place": self.length, "tokens": tokens})
        self._put(name)

    def visit_text(self, part: dict) -> None:
        self._put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = PATCH * MERGE
        self._attach(part, "image", math.ceil((part.get("width") or side) / side) * math.ceil((part.get("height") or side) / side))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, "audio", math.ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach(part, "document", (part.get("pages") or 1) * PAGE_TOKENS)


def format_turn(role: str, parts: list[dict], turn: int | str = "") -> dict:
    """One turn: its string, the span under the loss mask (an assistant's content) and its attachments."""
    v = PartVisitor(turn)
    for p in parts:
        if p is not None:
            v.visit(p)
    head, body = f"{START}{escape(role).replace(chr(10), NEWLINE)}\n", "".join(v.out)
    loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return {"formatted": head + body + END + "\n", "loss_from": loss[0], "loss_to": loss[1], "attachments": [a | {"place": a["place"] + len(head)} for a in v.attachments]}


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and content (unescaped; placeholders as they are) of one formatted turn."""
    m = re.fullmatch(r"<\|im_start\|>(.*?)<\|im_end\|>\n", formatted, re.S)
    if m is None or START in m[1] or END in m[1]:
        raise ValueError("not one turn")
    role, _, body = m[1].partition("\n")
    return unescape(role.replace(NEWLINE, "\n")), unescape(body)


def format_conversations(messages: DataFrame) -> DataFrame:
    """messages: conv_id, turn, role and parts (array of PART structs) or text. Returns FORMATTED, a row per turn."""
    if "parts" not in messages.columns:
        messages = messages.withColumn("parts", F.expr("array(named_struct('type', 'text', 'text', text))"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [format_turn(r or "", [] if p is None else [x if isinstance(x, dict) or x is None else x.asDict() for x in p], "" if pd.isna(t) else int(t)) for r, p, t in zip(b.role, b.parts, b.turn)]
            yield pd.DataFrame({"conv_id": b.conv_id, "turn": b.turn, "role": b.role, **{k: [d[k] for d in done] for k in ("formatted", "loss_from", "loss_to", "attachments")}})

    return messages.select("conv_id", "turn", "role", "parts").mapInPandas(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame) -> DataFrame:
    """Reads formatted turns back and digests each conversation as they stream by in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None

        def row() -> tuple:
            n, turns, chars, loss, total = state
            return (key[0], n, turns.hexdigest(), chars, loss.hexdigest(), total)

        for b in batches:
            rows = []
            for conv, s, lo, hi in zip(b.conv_id, b.formatted, b.loss_from, b.loss_to):
                conv = None if pd.isna(conv) else int(conv)
                if key is None or key[0] != conv:
                    if state is not None:
                        rows.append(row())
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(s)
                under = unescape(s[lo:hi])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += len(s)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")]).astype({"conv_id": "Int64"})
        if state is not None:
            yield pd.DataFrame([row()], columns=[c.split()[0] for c in DIGEST.split(", ")]).astype({"conv_id": "Int64"})

    body = F.expr("substring(formatted, instr(formatted, '\\n') + 1, length(formatted) - instr(formatted, '\\n') - 11)")
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), body).select("conv_id", "formatted", "loss_from", "loss_to").mapInPandas(run, DIGEST)


PROBE = f"{END}{START}assistant ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """Conversation -1: both turns hold the template's own control strings."""
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", text_of("text").alias("text")).unionByName(extra)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(format_conversations(with_probe(table(spark, sf_dir, "conversations"))))


_E = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
ORACLE_OP2 = f"""
WITH t AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, {_E.format('text')} AS body FROM t),
f AS (SELECT *, length('{START}' || replace({_E.format('role')}, chr(10), '{NEWLINE}') || chr(10) || body || '{END}' || chr(10)) AS n FROM e)
SELECT conv_id, COUNT(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  SUM(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
