from sievework.llm.chat import expand


def brute(rows):
    out = {}
    key = lambda r: tuple((v is not None, v) for v in r[1:])
    convs = {}
    for r in rows:
        if r[0] is not None:
            convs.setdefault(r[0], []).append(r)
    for c, turns in convs.items():
        context, n = "", 0
        for k, (_, turn, role, text) in enumerate(sorted(turns, key=key)):
            if role is not None and role.strip().lower() == "assistant" and text:
                out[(c, n)] = (turn, k, context + "<|im_start|>assistant\n", text + "<|im_end|>\n")
                n += 1
            context += f"<|im_start|>{'user' if role is None else role}\n{text or ''}<|im_end|>\n"
    return out


ROWS = [
    (1, 0, "system", "be good"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "more"), (1, 4, " Assistant ", "ünï ✓"), (2, 0, "assistant", "first"), (3, 0, "user", "none"), (4, 0, "assistant", None), (4, 1, "assistant", ""), (4, 2, None, None), (4, 3, "assistant", "x" * 300_000),
    (4, 4, "assistant", "after"), (None, 0, "assistant", "lost"), (5, 1, "assistant", "tie"), (5, 1, "assistant", "tie"), (5, None, "user", "before"), (5, 1, "user", "b"), (6, 10, "assistant", "late"), (6, 9, "user", "ask"),
]


def test_every_reply_has_all_turns_before_it(spark):
    df = spark.createDataFrame([(*r, "c", "p", 0) for r in ROWS], "conv_id long, turn long, role string, text string, context string, prompt string, example int")
    got = {(r["conv_id"], r["example"]): r for r in expand(spark, df.repartition(5)).collect()}
    want = brute(ROWS)
    assert got.keys() == want.keys()
    for k, (turn, n, prompt, completion) in want.items():
        r = got[k]
        assert (r["turn"], r["context_turns"], r["prompt"], r["completion"]) == (turn, n, prompt, completion)
        whole = r["prompt"] + r["completion"]
        assert whole[r["train_from"] : r["train_to"]] == completion and r["train_to"] == len(whole)


def test_empty_table(spark):
    assert expand(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
