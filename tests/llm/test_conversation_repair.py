"""Conversation repair against trying every string of edits, and against SQL on odd rows."""

import hashlib
import itertools
import random
import re

import pytest

from scanhouse.llm import conversation_repair as cr
from tests.compare import compare

TURNS = "conv_id bigint, turn bigint, role string, text string"
CODES = list(itertools.product("suax", (cr.SOUND, cr.CUT_OFF, cr.BAD)))


def all_repairs(codes):
    """(cost, edits) of every string of edits with at most two inserts in a place that gives the wanted initials."""

    def go(i, seq, cost, edits, inserts):
        if not re.fullmatch(r"(s?(ua)*u?)?", seq):
            return
        if i == len(codes) and re.fullmatch(r"(s?(ua)+)?", seq):
            yield cost, edits
        if inserts < 2:
            for role in "ua":
                yield from go(i, seq + role, cost + 3, edits + "I", inserts + 1)
        if i == len(codes):
            return
        initial, fault = codes[i]
        extra = 3 if fault == cr.CUT_OFF else 0
        yield from go(i + 1, seq, cost + 4, edits + "D", 0)
        if fault != cr.BAD:
            yield from go(i + 1, seq + initial, cost + extra, edits + "K", 0)
            for role in "ua":
                yield from go(i + 1, seq + role, cost + 3 + extra, edits + "R", 0)

    return go(0, "", 0, "", 0)


def test_first_accepting_path_is_the_cheapest_and_least():
    rng = random.Random(3)
    for _ in range(300):
        codes = [rng.choice(CODES) for _ in range(rng.randint(0, 3))]
        assert cr.cheapest(codes, cr.START, None) == min(all_repairs(codes)), codes


def test_lower_bound_never_exceeds_the_cost():
    rng = random.Random(4)
    for _ in range(200):
        codes = [rng.choice(CODES) for _ in range(rng.randint(0, 3))]
        assert cr.lower_bounds(codes)[0][cr.START] <= min(all_repairs(codes))[0]


def conversation(rows):
    repair = cr.Repair({})
    for turn, (role, text) in enumerate(rows):
        repair.add(turn, role, text)
    return repair.result()


def test_blocks_do_not_change_a_repair(monkeypatch):
    rng = random.Random(8)
    texts = ["Yes.", "No!", "cut off", " ", "Why?", "More."]
    talks = [[(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(texts) + (str(i) + "." if rng.random() < 0.7 else "")) for i in range(rng.randint(0, 40))] for _ in range(120)]
    whole = [conversation(t) for t in talks]
    for size in (1, 2, 7):
        monkeypatch.setattr(cr, "BLOCK", size)
        assert [conversation(t) for t in talks] == whole


def test_a_long_conversation_is_linear():
    rows = [(("user", "assistant")[i % 2], f"Sentence {i}" + (".", ".", "", ".")[i * 7 % 11 % 4]) for i in range(20_000)]
    del rows[500::997]
    out = conversation(rows)
    assert len(out[6]) >= len(rows) and out[5] > 0


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."),
    (2, None, "user", "No turn?"), (2, None, None, "No role."), (2, 5, "assistant", None), (2, 9, "user", ""),
    (3, None, None, None),
    (None, 0, "user", "No id."), (None, 2, "user", "No id."), (None, 2, "user", "No id."), (None, 3, "assistant", "cut"),
    (4, 0, "tool", "\x0b\x0c"), (4, 0, "tool", "Result "), (4, -3, "assistant", "Ends with space. \n"),
    (5, 7, "assistant", "long " * 40000 + "."), (5, 8, "user", "Line one.\nline two!"),
    *[(6, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(30)],
    *[(c, t, r, f"Said {t}.") for c in range(100, 160) for t, r in enumerate(["user", "assistant"] * 2)],
]


def test_odd_rows_equal_sql(spark):
    import duckdb

    df = spark.createDataFrame(ODD, TURNS).selectExpr("*", "'x' AS lost", "'x' AS cost", "'x' AS audit", "1 AS _copy")
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(ODD, TURNS).toArrow())
    res = compare(cr.repair_conversations(df, damage=True), con, cr.ORACLE)
    assert res["ok"], res


def test_undamaged_faults_and_text(spark):
    rows = {r["conv_id"]: r for r in cr.repair_conversations(spark.createDataFrame(ODD, TURNS)).collect()}
    assert len(rows) == 5 + 1 + 1 + 60
    assert rows[1][1:8] == (0, 0, 0, 0, 0, 0, "KKK")
    assert rows[1]["repaired_sha256"] == hashlib.sha256(b"system:Be kind.\nuser:Hi.\nassistant:Hello.").hexdigest()
    # "No role." sorts before "No turn?": no state reads its role, so it is deleted or given one
    assert rows[2][1:6] == (3, 2, 0, 0, 1)
    assert rows[3][1:8] == (0, 1, 0, 0, 0, 4, "D")
    assert rows[None][1:6] == (1, 0, 2, 1, 2)


@pytest.mark.parametrize("damage", [False, True])
def test_no_rows(spark, damage):
    assert cr.repair_conversations(spark.createDataFrame([], TURNS), damage).count() == 0
