from shoplens.llm import chat

NODE = "tree long, node long, parent long, role string, text string, score double"


def test_best_branch_of_a_reply_tree(spark):
    rows = [
        (1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "better", 3.0), (1, 4, 2, "user", "more", 4.0),
        (1, 5, 3, "user", "less", 1.0), (1, 6, 4, "assistant", "end", 0.0), (2, 1, None, "user", None, None), (3, 1, 9, "user", "orphan", 1.0), (3, 2, 3, "user", "later parent", 1.0),
        (None, 1, None, "user", "a null tree", 0.0), (None, 2, 1, "assistant", "answers", 0.0), (1, 6, 4, "assistant", "end", 0.0),
    ]
    out = {(r.tree, r.branch): r for r in chat.format_trees(spark.createDataFrame(rows, NODE), branches=2).collect()}
    texts = {k: [(t.role, t.text) for t in spark.createDataFrame([(r.formatted,)], "f string").select(chat.read_back(chat.F.col("f"))).first()[0]] for k, r in out.items()}
    assert texts[1, 1] == [("user", "root"), ("assistant", "good"), ("user", "more"), ("assistant", "end")]
    assert texts[1, 2] == [("user", "root"), ("assistant", "better"), ("user", "less")]
    assert texts[2, 1] == [("user", "")] and {texts[3, 1][0][1], texts[3, 2][0][1]} == {"orphan", "later parent"}
    assert texts[None, 1] == [("user", "a null tree"), ("assistant", "answers")]
    assert len(out) == 6


def test_deep_chain_and_control_strings_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\n\\", "<s></s>", "[INST", "", "a\n\nb", "<\\/s>", "ends <", "</", "é😀[/INST] ", "<<SYS>>x<</SYS>>", None]
    rows = [(7, i, ["user", "assistant", "[/INST] odd role </s>"][i % 3], odd[i % len(odd)]) for i in range(150)]
    rows += [(8, None, "user", "null turn"), (8, 1, "user", "first"), (8, 1, "assistant", "same turn"), (9, 0, None, "no role")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_trees(chat.chain(turns))
    back = {r.tree: r for r in formatted.select("tree", chat.read_back(chat.F.col("formatted")).alias("turns"), chat.loss_text(chat.F.col("formatted"), chat.F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in back[7].turns] == [(r, t or "") for _, _, r, t in rows[:150]]
    assert back[7].loss == "".join(t or "" for _, _, r, t in rows[:150] if r == "assistant")
    assert [(t.role, t.text) for t in back[8].turns] == [("assistant", "same turn"), ("user", "first"), ("user", "null turn")]
    assert [(t.role, t.text) for t in back[9].turns] == [("", "no role")]
    assert chat.format_trees(chat.chain(turns.limit(0))).collect() == []
