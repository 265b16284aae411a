"""Examples read back exactly."""
import hashlib

from arealytics.llm import chat_format

NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_start|>", "<\\\\|im_end|>", "a\n<|im_end|>\n", "", None, "\\n\\s\\", "<<|im_start|>>", "x" * 200_000]


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "z") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, example int, last string")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_equal_the_rows(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], x) for i, x in enumerate(NASTY)]
    rows += [(2, 0, "user", "only"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, None, "system\n\\x", "first"), (None, 1, None, "q"), (None, 2, "assistant", "r")]
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.examples(table(spark, rows))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv], key=lambda t: (t[0] is not None, t))
        loss = "".join(t[2] for t in own if t[1] == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == sha("".join(f"{t[1]}\n{t[2]}\n" for t in own))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), sha(loss))


def test_each_reply_is_trained_once_with_all_before_it(spark):
    rows = [(7, i, r, f"t{i}") for i, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"])]
    made = sorted(chat_format.examples(table(spark, rows)).collect(), key=lambda r: r["example"])
    assert [r["text"][r["loss_start"]:r["loss_end"]] if r["loss_start"] is not None else None for r in made] == ["t2", "t4", None]
    assert made[1]["text"].startswith(made[0]["text"]) and made[2]["text"].count("<|im_start|>") == 6 and [r["last"] for r in made] == [False, False, True]
    assert chat_format.examples(table(spark, [])).collect() == []
