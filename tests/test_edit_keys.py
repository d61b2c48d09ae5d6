"""Edit keys of whole turns on hand-made rows."""

from spanloom.plans.set_queries import q61_edit_keys, q61b_shape_keys


def test_edits_behind_the_fourth_word_and_long_edits(spark, tmp_path):
    many = " ".join(f"w{i}" for i in range(7))
    turns = ["a b c d e f", "a b c d x f", "a b c d the f", "a b c d the f", f"a b c d {many} f", None, " ".join(f"x{i}" for i in range(600)), " ".join(f"y{i}" for i in range(600))]
    spark.createDataFrame([(1, i, x) for i, x in enumerate(turns)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r)[1:] for r in q61_edit_keys(spark, str(tmp_path)).orderBy("turn", "n").collect()]
    assert got == [
        (1, 0, True, "e → x", "$ → $"), (2, 0, True, "x → the", "$ → the"), (4, 0, True, None, None), (5, 0, True, None, None), (6, 0, True, None, None), (7, None, False, None, None),
    ]


def test_one_shape_for_all_edits_of_a_turn(spark, tmp_path):
    long, huge = " ".join(f"w{i}" for i in range(7)), " ".join(f"h{i}" for i in range(41))
    turns = ["a b c", "a x c", "a the c 5", "a the c 6 q", f"a {long} c 6 the", f"{huge} the", f"{huge} the", None]
    spark.createDataFrame([(1, i, x) for i, x in enumerate(turns)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.turn, r.compared, r.shape, r.words) for r in q61b_shape_keys(spark, str(tmp_path)).orderBy("turn").collect()]
    assert got == [
        (1, True, None, None),  # an identifier for another says nothing
        (2, True, "$ → the |  → 5", "`$` replaced by `the`; added `5`"),
        (3, True, "5 → 6 $", "`5` replaced by `6 $`"),
        (4, True, "⟪1 → 7⟫ | $ → the", "1 token replaced by 7; `$` replaced by `the`"),
        (5, True, None, None),  # an edit of over forty tokens
        (6, True, None, None),  # nothing changed
        (7, True, None, None),
    ]
