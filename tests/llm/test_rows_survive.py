"""Which rows leave the pipeline's first stages: by their texts, not by their doc_id."""

from tessella.llm import langid, near_dedup

SF = "/root/testdata/sf0.001"
WORDS = "one two three four five six seven eight nine ten eleven twelve"


def held(rows):
    return sorted(((r["doc_id"], r["text"], r["n"]) for r in rows), key=str)


def test_languages_judge_each_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(200)
    good = docs.where("lang = 'en' and length(text) > 400").orderBy("doc_id").first()
    extra = [(None, good["text"], None, 1), (good["doc_id"], "12345 6789", None, 2), (good["doc_id"], None, None, 3), (None, "1 2 3", None, 4), (None, good["text"], None, 2**60 + 1)]
    rows = docs.selectExpr("*", "0L as n").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, n long"))
    out = {r["doc_id"] for r in langid.classify(docs, langid.fit(langid.learning(docs))).where("rejected").collect()}
    assert good["doc_id"] not in out
    kept = langid.keep_languages(rows)
    assert kept.schema == rows.schema
    assert held(kept.collect()) == held([r for r in rows.collect() if r["n"] in (1, 2**60 + 1) or (r["n"] == 0 and r["doc_id"] not in out)])


def test_near_dedup_keeps_one_row_of_each_class(spark):
    near, other, third = f"{WORDS} thirteen fourteen fifteen", "quite unlike words stand in this second text of ours", "a third text with words of its own and none of theirs"
    rows = [(None, other, 1), (1, WORDS, 2), (1, third, 3), (1, WORDS, 4), (0, near, 5), (None, other, 6), (None, WORDS.upper(), 7), (2, "", 8), (2, None, 9), (None, "", 10), (None, None, 11)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    texts = sorted(((r["doc_id"], r["text"]) for r in got if r["text"]), key=str)
    words, more = (frozenset(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in (WORDS, near))
    assert 100 * len(words & more) < 75 * len(words | more)
    assert texts == sorted([(None, other), (1, WORDS), (1, third), (0, near)], key=str)
    assert sum(r["doc_id"] == 2 for r in got) == 1 and sum(r["n"] in (10, 11) for r in got) == 2 and len(got) == 7
