"""joined_pages reaches every page up to 50."""

from quire.plans import catalogue


def test_all_pages_are_joined(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    want, confidence = {}, {}
    for r in sorted((r for r in rows if r["turn"] <= 50 and (r["text"] or "").strip(" ")), key=lambda r: (r["conv_id"], r["turn"], r["text"])):
        want.setdefault(r["conv_id"], []).append(f"--- Page {r['turn']} ---\n{r['text']}")
        confidence.setdefault(r["conv_id"], []).append(len(r["text"]) % 97)
    assert any(r["turn"] > 3 for r in rows)
    got = catalogue.queries()["joined_pages"](spark, sf_dir).collect()
    assert {r["conv_id"]: r["text"] for r in got} == {k: "\n\n".join(v) for k, v in want.items()}
    assert all(abs(r["confidence"] - sum(confidence[r["conv_id"]]) / len(confidence[r["conv_id"]])) < 1e-9 for r in got)
