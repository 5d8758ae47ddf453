"""Chat formatting: exact round trips, attachments and the loss mask."""

import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewell.llm import chat
from tidewell.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "[OUT] ", "</s>", "[IMG:0]", "[ROLE] ", "[SAYS] ", " [/ROLE]", " ", "a", "\n", "é", "DOC:12]"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "[SAYS] </s>"]), st.lists(st.sampled_from(BITS), max_size=8)), min_size=1, max_size=4))
def test_any_text_comes_back(turns):
    said, want, trained = "", [], []
    for role, bits in turns:
        parts = [{"kind": "text", "text": b} for b in bits]
        piece, spans, attached, tokens = chat.format_turn(role, parts, chat.Costs())
        assert chat.read_turns(piece) == [(role, "".join(bits))] and not attached and not tokens
        assert chat.under_mask(piece, [{"start": a, "end": b} for a, b in spans]) == ("".join(bits) if role == "assistant" else "")
        said += piece
        want.append((role, "".join(bits)))
    assert chat.read_turns(said) == want


def test_parts(spark):
    part = lambda kind, **x: (kind, x.get("text"), x.get("ref"), x.get("width"), x.get("height"), x.get("seconds"), x.get("pages"))
    rows = [
        ("user", [part("text", text="look ["), part("text", text="INST] at "), part("image", ref="a.png", width=65, height=32), None, part("text", text=" and "), part("audio", ref="b.wav", seconds=2.5), part("document", ref="c.pdf", pages=3)]),
        ("assistant", [part("text", text="one"), part("image", ref="d.png"), part("text", text="two"), part("video", text="?")]),
        (None, None),
    ]
    df = spark.createDataFrame(rows, f"role string, parts array<{chat.PART}>").withColumn("loss", F.lit("mine")).withColumn("turn", F.lit(3))
    got = chat.formatted(df)
    assert got.columns == ["role", "parts", "turn", "formatted", "loss", "attachments", "expanded_tokens"]
    user, bot, none = sorted(got.collect(), key=lambda r: {"user": 0, "assistant": 1, None: 2}[r.role])
    assert user.formatted == "[INST] look [\\INST] at [IMG:0] and [AUD:1][DOC:2] [/INST]"
    assert [(a.place, a.kind, a.ref, a.tokens) for a in user.attachments] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 63), (2, "document", "c.pdf", 1536)]
    assert [user.formatted[a.start : a.start + 7] for a in user.attachments] == ["[IMG:0]", "[AUD:1]", "[DOC:2]"]
    assert user.expanded_tokens == 1602 and user.loss == []
    assert bot.formatted == "[OUT] one[IMG:0]two?</s>" and chat.under_mask(bot.formatted, bot.loss) == "onetwo?" and bot.expanded_tokens == 1
    assert none.formatted == "[ROLE] [SAYS]  [/ROLE]" and none.attachments == []


def expected(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in [*rows, (-7, 0, "user", chat.EXTRA[1]), (-7, 1, "assistant", chat.EXTRA[1])]:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, mine in convs.items():
        mine = [(r, t) for _, _, r, t in sorted(mine)]
        trained = "".join(t for r, t in mine if r == "assistant")
        out.append((conv, len(mine), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest()))
    return sorted(out, key=str)


def test_report(spark):
    rng = random.Random(3)
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["".join(rng.choices(BITS, k=5)), None, "", "long " * 20_000])) for conv in (None, 1, 2, 3) for turn in range(9)]
    rows += [(4, None, "user", "x"), (4, None, "user", "x"), (4, 0, "assistant", "y"), (5, 0, "user", "a"), (5, 0, "assistant", "b")]
    rng.shuffle(rows)
    for df in (spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("mine")).withColumn("conv", F.lit(0)), table(spark, SMALL, "conversations")):
        plain = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
        got = chat.chat_report(df).drop("formatted_chars")
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected(plain)
    assert [r.conv_id for r in chat.chat_report(spark.createDataFrame([], SCHEMA)).collect()] == [-7]
