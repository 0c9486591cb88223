import hashlib
import re
from collections import defaultdict

from scanhouse.llm.chat_format import chat_digests, format_conversations, prefix_targets

TURNS = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "hi <s> there\n"),
    (1, 2, "assistant", "hello ~0 ~1 ~ [INST] x [/INST] </s>"),
    (1, 3, "user", None),
    (1, 4, "assistant", ""),
    (1, 5, "user", "bye"),
    (2, 0, "user", "<<SYS>> no reply <</SYS>> <|x|>"),
    (3, 0, "assistant", "<~1s> first 日本 𝒳"),
    (3, 0, "assistant", "<~1s> first 日本 𝒳"),
    (4, None, "assistant", "no turn"),
    (4, 1, None, "no role"),
    (4, 2, "to\nol", "\n\n"),
    (None, 0, "assistant", "no conversation"),
    (5, 0, "user", "long " * 50000),
    (5, 1, "assistant", "~" * 3000),
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_reads_back_every_text(spark):
    groups = defaultdict(list)
    for conv, turn, role, text in TURNS:
        groups[conv].append((turn is not None, turn, role or "", text or ""))
    want = []
    for conv, rows in groups.items():
        rows = sorted(rows, key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        turns = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
        loss = "".join(t for _, _, r, t in rows if r == "assistant")
        want.append((conv, len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    df = spark.createDataFrame(TURNS, SCHEMA).selectExpr("*", "1 AS loss", "2 AS formatted").repartition(5)
    got = chat_digests(df).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)


def test_each_reply_is_an_example_with_all_turns_before(spark):
    formatted = format_conversations(spark.createDataFrame(TURNS, SCHEMA))
    whole = {r.conv_id: r.formatted for r in formatted.collect()}
    examples = [r for r in prefix_targets(formatted).collect() if r.conv_id == 1]
    assert len(examples) == 2
    for r in examples:
        assert whole[1].startswith(r.text) and r.text.endswith("</s>") and r.loss_stop == len(r.text) - 4
    assert [r.text.count("<s>") for r in sorted(examples, key=lambda r: r.example)] == [3, 5]
    assert not re.search(r"<s>|</s>|\[/?INST\]|<</?SYS>>|<\|", examples[0].text[examples[0].loss_start : examples[0].loss_stop])


def test_no_rows_and_no_python(spark):
    df = chat_digests(spark.createDataFrame([], SCHEMA))
    assert df.count() == 0
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
