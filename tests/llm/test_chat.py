from gleanery.llm import chat


def test_turns_without_a_number_stay_on_both_sides(spark):
    turns = [(0, None, "system", "be brief"), (0, 1, "user", "hi"), (0, 2, "assistant", "yes"), (1, None, "system", "x"), (1, 1, "user", "hi"), (1, 2, "assistant", "no"), (2, 1, "user", "alone"), (5, 1, "user", "alone")]
    got = chat.formatted(chat.neighbour_pairs(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))).collect()
    assert [(r.pair_id, r.n_prompt_turns) for r in got] == [(0, 2)]
    assert got[0].prompt.startswith(f"{chat.START}system\nbe brief") and "yes" in got[0].chosen and "no" in got[0].rejected


def test_long_conversations(spark):
    turns = [(c, n, ("user", "assistant")[n % 2], f"t{n if n < 2999 else (n, c)} " * 3) for c in (0, 1) for n in range(3000)]
    (got,) = chat.formatted(chat.neighbour_pairs(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))).collect()
    assert got.n_prompt_turns == 2999 and got.prompt.count(chat.START) == 2999 and "(2999, 0)" in got.chosen and "(2999, 1)" in got.rejected
    assert chat.formatted(chat.neighbour_pairs(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).count() == 0
