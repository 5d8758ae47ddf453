"""Chat formatting from typed content parts.

A message is a list of parts: text, image, audio and document. A visitor flattens them in order: text goes in escaped,
every other part leaves a placeholder, a reference to what is attached and the number of tokens it expands to. A template
of control strings marks turns. Control strings within texts get one backslash more after their first sign, so that a
formatted conversation holds no others than the template's and can be read back exactly.

Turns are formatted each by itself, in parallel; a conversation is its turns' pieces in order, so that none has to fit
into one value.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches

#: The template's control strings; {n} of a placeholder numbers the attachments of a message.
TURNS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>")}
OTHER = ("[ROLE] ", "[SAYS] ", " [/ROLE]")
PLACES = {"image": "IMG", "audio": "AUD", "document": "DOC"}
NAMES = r"/?s>|/?INST\]|/?SYS\]|OUT\]|/?ROLE\]|SAYS\]|(?:IMG|AUD|DOC):[0-9]+\]"
_PLAIN = re.compile(rf"([<\[])(\\*)({NAMES})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({NAMES})")
_MARK = re.compile(rf"[<\[](?:{NAMES})")

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<place:int,kind:string,ref:string,start:int,tokens:long>"
SPAN = "struct<start:int,end:int>"
PIECE = f"formatted string, loss array<{SPAN}>, attachments array<{ATTACHMENT}>, expanded_tokens long"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text) if "[" in text or "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


@dataclass
class Costs:
    """What attachments expand to: an image's tiles, tokens a second of audio, tokens a page."""

    tile: int = 32
    per_second: float = 25.0
    per_page: int = 512


@dataclass
class Flat:
    """Visits the parts of one message in order; `base` is where its text begins in the formatted turn."""

    costs: Costs
    base: int
    pieces: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple] = field(default_factory=list)
    at: int = 0
    text: str = ""  # of the parts since the last attachment: a control string may not come about between two of them

    def put(self, said: str) -> tuple[int, int]:
        self.pieces.append(said)
        self.at += len(said)
        return self.base + self.at - len(said), self.base + self.at

    def visit(self, part) -> None:
        getattr(self, f"visit_{part['kind'] if part['kind'] in PLACES else 'text'}")(part)

    def visit_text(self, part) -> None:
        self.text += part["text"] or ""

    def flush(self) -> None:
        if self.text:
            self.spans.append(self.put(escape(self.text)))
            self.text = ""

    def attach(self, part, tokens: float) -> None:
        self.flush()
        n = len(self.attachments)
        start, _ = self.put(f"[{PLACES[part['kind']]}:{n}]")
        self.attachments.append((n, part["kind"], part["ref"], start, max(1, math.ceil(tokens))))

    def visit_image(self, part) -> None:
        tiles = math.ceil((part["width"] or 0) / self.costs.tile) * math.ceil((part["height"] or 0) / self.costs.tile)
        self.attach(part, tiles)

    def visit_audio(self, part) -> None:
        self.attach(part, (part["seconds"] or 0.0) * self.costs.per_second)

    def visit_document(self, part) -> None:
        self.attach(part, (part["pages"] or 0) * self.costs.per_page)


def format_turn(role: str | None, parts, costs: Costs) -> tuple:
    """(formatted, loss spans, attachments, tokens that the attachments expand to) of one turn."""
    role = role or ""
    before, after = TURNS.get(role, (None, None))
    if before is None:
        before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    flat = Flat(costs, len(before))
    for part in parts:
        flat.visit(part)
    flat.flush()
    return before + "".join(flat.pieces) + after, flat.spans if role == "assistant" else [], flat.attachments, sum(a[4] for a in flat.attachments)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, content) of every turn of a formatted conversation or piece; placeholders stay in the content."""
    by_mark = {b.strip(): (role, len(b), a) for role, (b, a) in TURNS.items()}
    out, at = [], 0
    while at < len(formatted):
        mark = _MARK.match(formatted, at)[0]
        if mark == OTHER[0].strip():
            says = next(m for m in _MARK.finditer(formatted, at + len(OTHER[0])) if m[0] == OTHER[1].strip())
            role, start, after = unescape(formatted[at + len(OTHER[0]) : says.start()]), says.start() + len(OTHER[1]), OTHER[2]
        else:
            role, n, after = by_mark[mark]
            start = at + n
        end = next(m for m in _MARK.finditer(formatted, start) if m[0] == after.strip()).start() - (len(after) - len(after.strip()))
        out.append((role, unescape(formatted[start:end])))
        at = end + len(after)
    return out


def under_mask(formatted: str, loss) -> str:
    return "".join(unescape(formatted[s["start"] : s["end"]]) for s in loss)


def formatted(messages: DataFrame, parts_col: str | None = "parts", costs: Costs = Costs()) -> DataFrame:
    """messages (role, and the column of parts, an array of PART, or with parts_col None a column text) with formatted,
    loss, attachments and expanded_tokens; their other columns stay, but for those with these names.

    loss holds the code points of the formatted turn that are trained on, those of the texts of assistants, escaped as
    they are. attachments number the placeholders of the turn: place, kind, ref, start and the tokens it expands to (one
    at least). A part of another kind, or none, counts as text; null texts, parts and roles are empty ones.
    """
    bounded_batches(messages.sparkSession)
    spec = StructType.fromDDL(PIECE)
    kept = [c for c in messages.columns if c.lower() not in {f.name for f in spec}]
    given = F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"))) if parts_col is None else F.col(parts_col)

    @F.pandas_udf(spec)
    def turn(role: pd.Series, parts: pd.Series) -> pd.DataFrame:
        done = [format_turn(r, [p for p in (ps if ps is not None else []) if p is not None], costs) for r, ps in zip(role, parts)]
        return pd.DataFrame({"formatted": [d[0] for d in done], "loss": [[dict(zip(("start", "end"), s)) for s in d[1]] for d in done], "attachments": [[dict(zip(("place", "kind", "ref", "start", "tokens"), a)) for a in d[2]] for d in done], "expanded_tokens": [d[3] for d in done]})

    return messages.select(*[F.col(f"`{c}`") for c in kept], turn(F.col("role"), given).alias("_tw_turn")).select(*[F.col(f"`{c}`") for c in kept], "_tw_turn.*")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a conversation's pieces say when they are read back, in order, as they come: a row each conversation."""
    now, state = None, None

    def done():
        conv, n, turns, loss_chars, loss, chars = state
        return (None if conv == "" else int(conv), n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for pdf in batches:
        out = []
        for conv, said, loss in zip(pdf["conv"], pdf["formatted"], pdf["loss"]):
            if conv != now:
                if state is not None:
                    out.append(done())
                now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_turns(said):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            trained = under_mask(said, loss)
            state[3] += len(trained)
            state[4].update(trained.encode("utf-8", "surrogatepass"))
            state[5] += len(said)
        if out:
            yield pd.DataFrame(out, columns=cols)
    if state is not None:
        yield pd.DataFrame([done()], columns=cols)


#: The conversation of the contract whose texts hold control strings.
EXTRA = (-7, "</s>[INST] ok [/INST]")


def chat_report(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of conversations and conversation -7: what is read back from their formatted turns.

    Rows go by turn, nulls first; rows of one turn by role, then by their escaped text. Null texts and roles are empty; a null conv_id
    is a conversation. Repeated rows are turns each. Texts may be very long; extra columns are not read. An empty table
    gives conversation -7 alone. Turns are formatted where they lie; the pieces of a conversation then pass one task, in
    order and in bounded memory, since a digest can't be put together from parts.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    extra = spark.range(2).select(F.lit(EXTRA[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA[1]).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(extra)
    rows = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = formatted(rows, None).select("conv", "turn", "role", "formatted", "loss")
    pieces = pieces.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "formatted")
    return pieces.select("conv", "formatted", "loss").mapInPandas(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_CHARS = " ".join(f"WHEN '{role}' THEN {len(b) + len(a)}" for role, (b, a) in TURNS.items())
_ESCAPE = rf"regexp_replace({{}}, '([<\[])(\\*)({NAMES})', '\1\\\2\3', 'g')"

ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA[0]}, 0, 'user', '{EXTRA[1]}' UNION ALL SELECT {EXTRA[0]}, 1, 'assistant', '{EXTRA[1]}'),
e AS (SELECT *, {_ESCAPE.format("text")} AS said FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, said)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, said) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(said) + CASE role {_CHARS} ELSE {sum(len(x) for x in OTHER)} + length({_ESCAPE.format("role")}) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
