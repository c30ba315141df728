"""Which entities get another permutation does not hang on how many others share their shape."""

from lotweave.llm import surrogates


def test_a_crowded_shape_is_checked_too(spark):
    # a million strings of a shape, 3 000 of them entities
    rows = spark.createDataFrame([("phone", f"{i:06d}") for i in range(0, 9000, 3)], "kind string, key string")
    odd = surrogates.exceptions(rows)
    final = rows.join(odd, ["kind", "key"], "left").selectExpr("array(struct(kind, key, coalesce(attempt, 0) as attempt)) as e")
    made = [(r["key"], r["made"]) for r in surrogates.with_surrogates(final, "e", surrogates.KEY).selectExpr("inline(e)").collect()]
    keys = {k for k, _ in made}
    assert odd.count() > 0 and len({m for _, m in made}) == len(made) == 3000 and not keys & {m for _, m in made}
