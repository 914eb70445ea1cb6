"""Every query of the engine and its oracle in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import html as H
from tessella.functions import text as T
from tessella.operators import chunking as C
from tessella.operators.ann import VectorIndex
from tessella.operators.layout import dealt, numbered
from tessella.operators.postings import Postings
from tessella.operators import retrieval as R
from tessella.operators import store as S
from tessella.sources import files as readers
from tessella.sources.files import near_rows
from tessella.streaming.ingest import event_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUESTION = "the of and thation er"
STOPWORDS = ["the", "of", "and"]
DEFAULTS = ["What is this about?", "Who wrote it?", "When was it written?", "Where is more?"]


def _documents(t):
    """The documents, dealt out for functions of whole texts."""
    return dealt(t("documents"))


def _pages(t):
    """The pages, dealt out for functions of whole pages."""
    return dealt(t("pages"))


def query(oracle: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


L2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))"
DOT = "list_sum(list_transform(list_zip({0}.embedding, {1}.embedding), lambda z: z[1]::DOUBLE * z[2]))"
COS = f"1 - {DOT.format('e', 'q')} / sqrt({DOT.format('e', 'e')} * {DOT.format('q', 'q')})"


def _first_vector(t):
    v = t("embeddings")
    return v.where("vec_id = 0").first()["embedding"], v.select(F.col("vec_id").alias("id"), "embedding")


@query(f"SELECT id, round(d, 6) AS distance, row_number() OVER (ORDER BY d, id)::INT AS vector_rank FROM (SELECT e.vec_id AS id, {L2} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY d, id LIMIT 20)")
def vector_topk(t):
    q, v = _first_vector(t)
    return R.top_k(v, q).select("id", F.round("distance", 6).alias("distance"), "vector_rank")


@query(f"SELECT id, round(d, 6) AS distance, round(greatest(0, 1 - d), 6) AS similarity FROM (SELECT e.vec_id AS id, {COS} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY d, id LIMIT 20) WHERE greatest(0, 1 - d) >= 0.3")
def vector_threshold(t):
    q, v = _first_vector(t)
    return R.top_k(v, q, metric="cosine", min_similarity=0.3).select("id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query(f"SELECT query_id, id, round(d, 6) AS distance, vector_rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {L2} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2}, e.vec_id)::INT AS vector_rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE vector_rank <= 20")
def vector_topk_batch(t):
    v = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return R.top_k_batch(asked, v).select("query_id", "id", F.round("distance", 6).alias("distance"), "vector_rank")


def _chunks(t):
    return t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "role", "text")


@query("SELECT a.conv_id AS doc_id, a.turn AS chunk_index, b.turn AS neighbour, b.role AS role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN greatest(0, a.turn - 2) AND a.turn + 2")
def neighbors_window(t):
    c = _chunks(t)
    return R.neighbours(c.select("doc_id", "chunk_index"), c).select("doc_id", "chunk_index", F.col("n_chunk_index").alias("neighbour"), F.col("n_role").alias("role"))


HITS = "(SELECT conv_id, turn FROM conversations ORDER BY length(text) DESC, conv_id, turn LIMIT 20)"


def _hits(c):
    return c.orderBy(F.length("text").desc(), "doc_id", "chunk_index").limit(20).select("doc_id", "chunk_index")


@query(f"SELECT conv_id AS doc_id, turn AS chunk_index, role FROM conversations c WHERE EXISTS (SELECT 1 FROM {HITS} h WHERE h.conv_id = c.conv_id AND c.turn BETWEEN h.turn - 2 AND h.turn + 2)")
def expanded_search(t):
    c = _chunks(t)
    return R.expanded(_hits(c), c).select("doc_id", "chunk_index", "role")


@query(f"SELECT conv_id AS doc_id, turn AS chunk_index, role FROM conversations c WHERE EXISTS (SELECT 1 FROM {HITS} h WHERE h.conv_id = c.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1)")
def contextual_search(t):
    c = _chunks(t)
    return R.expanded(_hits(c), c, 1).select("doc_id", "chunk_index", "role")


WITHOUT = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda x: x <> ''"
TOKENS = WITHOUT + ")"


def _bm25_sql(candidates: str, stop: str = "") -> str:
    tokens = WITHOUT + (f" AND x NOT IN ({stop})" if stop else "") + ")"
    return f"""
cand AS ({candidates}),
toks AS (SELECT id, {tokens.format('content')} AS tk FROM cand),
terms AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tk) AS term FROM toks) GROUP BY ALL),
asked AS (SELECT term, count(*) AS times FROM (SELECT unnest({tokens.format(repr(QUESTION))}) AS term) GROUP BY term),
sizes AS (SELECT id, len(tk) AS dl FROM toks WHERE len(tk) > 0),
whole AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes),
raws AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM terms GROUP BY term), whole),
idfs AS (SELECT term, times, CASE WHEN raw >= 0 THEN raw ELSE 0.25 * (SELECT avg(raw) FROM raws) END AS idf FROM raws JOIN asked USING (term)),
scored AS (SELECT id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM terms JOIN idfs USING (term) JOIN sizes USING (id), whole GROUP BY id),
bm AS (SELECT cand.*, coalesce(s, 0) AS bm25_score FROM cand LEFT JOIN scored USING (id))"""


ALL_DOCS = "SELECT doc_id AS id, text AS content FROM documents"


def _as_chunks(t, table=None):
    return (t("documents") if table is None else table).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("file_name"))


@query(f"WITH {_bm25_sql(ALL_DOCS)} SELECT id, round(bm25_score, 6) AS bm25_score FROM bm")
def bm25_topk(t):
    return R.bm25(_as_chunks(t, _documents(t)), QUESTION).select("id", F.round("bm25_score", 6).alias("bm25_score"))


@query(f"WITH {_bm25_sql(ALL_DOCS, ', '.join(map(repr, STOPWORDS)))} SELECT id, round(bm25_score, 6) AS bm25_score FROM bm")
def bm25_stopwords(t):
    return R.bm25(_as_chunks(t, _documents(t)), QUESTION, STOPWORDS).select("id", F.round("bm25_score", 6).alias("bm25_score"))


@query(f"WITH {_bm25_sql(ALL_DOCS)} SELECT scored.id, source AS file_name, round(s, 6) AS bm25_score FROM scored JOIN documents ON doc_id = scored.id")
def bm25_postings(t):
    rows = _as_chunks(t, _documents(t))
    index = Postings(rows.sparkSession, S.workspace(rows.sparkSession))
    index.add(rows.where("id % 2 = 0"))
    index.add(rows.where("id % 2 <> 0"))
    return index.search(QUESTION, None).select(F.col("id").cast("bigint").alias("id"), "file_name", F.round("bm25_score", 6).alias("bm25_score"))


@query(f"WITH {_bm25_sql(ALL_DOCS)} SELECT CAST(id AS VARCHAR) AS id, round(s, 6) AS bm25_score FROM scored ORDER BY s DESC, CAST(id AS VARCHAR) LIMIT 20")
def bm25_postings_topk(t):
    rows = _as_chunks(t, _documents(t))
    index = Postings(rows.sparkSession, S.workspace(rows.sparkSession))
    index.add(rows)
    return index.search(QUESTION, R.TOP_K).select("id", F.round("bm25_score", 6).alias("bm25_score"))


@query(f"SELECT id, round(d, 6) AS distance FROM (SELECT e.vec_id AS id, {L2} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY d, id LIMIT 20)")
def vector_index_topk(t):
    """The index in its exact mode, grown by two additions; its usual mode is measured by recall in the tests."""
    q, v = _first_vector(t)
    rows = v.withColumn("file_name", F.lit("vectors"))
    index = VectorIndex(rows.sparkSession, S.workspace(rows.sparkSession), list_rows=100)
    index.add(rows.where("id % 3 <> 0"))
    index.add(rows.where("id % 3 = 0"))
    return index.nearest(q, R.TOP_K, exact=True).select("id", F.round("distance", 6).alias("distance"))


def _candidates(t):
    q, v = _first_vector(t)
    chunks = _as_chunks(t)
    near = R.top_k(v.join(chunks.select("id"), "id", "left_semi"), q, R.MOST_K).select("id", "vector_rank")
    return chunks.join(F.broadcast(near), "id").select("id", "content", "file_name", "vector_rank")  # at most MOST_K rows


CANDIDATES = f"SELECT *, row_number() OVER (ORDER BY d, id) AS vector_rank FROM (SELECT doc_id AS id, text AS content, source AS file_name, {L2} AS d FROM embeddings e JOIN documents ON doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY d, id LIMIT 50)"
FUSED = f"""WITH {_bm25_sql(CANDIDATES)},
ranked AS (SELECT *, row_number() OVER (ORDER BY bm25_score DESC, vector_rank) AS bm25_rank FROM bm),
rrf AS (SELECT *, 1.0::DOUBLE / (60 + vector_rank) + 1.0::DOUBLE / (60 + bm25_rank) AS rrf_score FROM ranked),
fused AS (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, vector_rank) AS fused_rank FROM rrf)"""
RERANKED = f"{FUSED}, reranked AS (SELECT *, 1.0 - (fused_rank - 1) * 0.01 AS ce_score, fused_rank AS rank FROM fused WHERE fused_rank <= 12)"


@query(f"{FUSED} SELECT id, vector_rank::INT AS vector_rank, bm25_rank::INT AS bm25_rank, round(rrf_score, 9) AS rrf_score FROM fused")
def rrf_fusion(t):
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("bm25_score"), "vector_rank")
    ranked = R.bm25(_candidates(t), QUESTION).withColumn("bm25_rank", F.row_number().over(w))
    return R.fused(ranked, ["vector_rank", "bm25_rank"]).select("id", "vector_rank", "bm25_rank", F.round("rrf_score", 9).alias("rrf_score"))


@query(f"""{RERANKED}, firsts AS (SELECT *, row_number() OVER (PARTITION BY left(md5(content), 16) ORDER BY rank) AS n FROM reranked),
capped AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY rank) AS f FROM firsts WHERE n = 1)
SELECT id, file_name, round(ce_score, 6)::DOUBLE AS ce_score, rank::INT AS rank, row_number() OVER (ORDER BY rank)::INT AS final_rank FROM capped WHERE f <= 1""")
def rerank_pipeline(t):
    done = R.postprocess(R.rerank(_candidates(t), QUESTION), 1)
    return done.select("id", "file_name", F.round("ce_score", 6).alias("ce_score"), "rank", "final_rank")


@query(f"{RERANKED} SELECT file_name, count(*) AS n, round(avg(abs(vector_rank - rank)), 6) AS mean_change, max(vector_rank - rank)::INT AS most_up, min(vector_rank - rank)::INT AS most_down, round(min(ce_score), 6)::DOUBLE AS least_score, round(max(ce_score), 6)::DOUBLE AS best_score FROM reranked GROUP BY file_name")
def rerank_analysis(t):
    found = R.rank_changes(R.rerank(_candidates(t), QUESTION))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_change", "least_score", "best_score")})


#: The texts of benchmark ask; each one's hits are the nearest 50 of the documents that fall to it.
BATCH = f"""WITH asks AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS query_id, text FROM benchmark), parts AS (SELECT count(*) AS p FROM benchmark),
hits AS (SELECT * FROM (SELECT doc_id % p AS query_id, doc_id AS id, text AS content, source AS file_name, row_number() OVER (PARTITION BY doc_id % p ORDER BY n_chars, doc_id) AS vector_rank FROM documents, parts) WHERE vector_rank <= 50),
toks AS (SELECT query_id, id, {TOKENS.format('content')} AS tk FROM hits),
terms AS (SELECT query_id, id, term, count(*) AS tf FROM (SELECT query_id, id, unnest(tk) AS term FROM toks) GROUP BY ALL),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format('text')}) AS term FROM asks) GROUP BY ALL),
sizes AS (SELECT query_id, id, len(tk) AS dl FROM toks WHERE len(tk) > 0),
whole AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM sizes GROUP BY query_id),
raws AS (SELECT query_id, term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT query_id, term, count(*) AS df FROM terms GROUP BY ALL) JOIN whole USING (query_id)),
means AS (SELECT query_id, avg(raw) AS mean FROM raws GROUP BY query_id),
scored AS (SELECT query_id, id, sum(times * CASE WHEN raw >= 0 THEN raw ELSE 0.25 * mean END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM terms JOIN asked USING (query_id, term) JOIN raws USING (query_id, term) JOIN means USING (query_id) JOIN sizes USING (query_id, id) JOIN whole USING (query_id) GROUP BY query_id, id),
ranked AS (SELECT hits.*, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 9) DESC, vector_rank) AS bm25_rank FROM hits LEFT JOIN scored USING (query_id, id)),
rrf AS (SELECT *, 1.0::DOUBLE / (60 + vector_rank) + 1.0::DOUBLE / (60 + bm25_rank) AS rrf_score FROM ranked),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, vector_rank) AS fused_rank FROM rrf),
reranked AS (SELECT *, fused_rank AS rank FROM fused WHERE fused_rank <= 12),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, left(md5(content), 16) ORDER BY rank) AS n FROM reranked),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_name ORDER BY rank) AS f FROM firsts WHERE n = 1)
SELECT query_id, id, file_name, bm25_rank::INT AS bm25_rank, rank::INT AS rank, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS final_rank FROM capped WHERE f <= 2"""


@query(BATCH)
def rerank_batch(t):
    asks = t("benchmark").select((F.row_number().over(Window.orderBy("item_id")) - 1).cast("bigint").alias("query_id"), "text")  # the queries
    parts = F.broadcast(t("benchmark").agg(F.count("*").alias("p")))
    rows = t("documents").join(parts).select((F.col("doc_id") % F.col("p")).alias("query_id"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("file_name"), "n_chars")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("n_chars", "id"))
    hits = rows.withColumn("vector_rank", nth).where(F.col("vector_rank") <= R.MOST_K).drop("n_chars")
    done = R.postprocess(R.rerank_many(hits, asks), 2, ("query_id",))
    return done.select("query_id", "id", "file_name", "bm25_rank", "rank", "final_rank")


@query("SELECT id FROM (SELECT doc_id AS id, row_number() OVER (PARTITION BY left(md5(text), 16) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_content_hash(t):
    return R.keep_first_by_content(_as_chunks(t), ["id"]).select("id")


@query("SELECT id, file_name FROM (SELECT doc_id AS id, source AS file_name, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3")
def cap_per_source(t):
    rows = t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_name"), "n_chars")
    return R.cap_per_file(rows, [F.desc("n_chars"), "id"]).select("id", "file_name")


WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


@query(f"SELECT doc_id, greatest(1, len({WORDS}))::INT AS words, round(greatest(1.0, length(text) / 4.0), 6)::DOUBLE AS chars4 FROM documents")
def token_counts(t):
    return _documents(t).select("doc_id", T.token_count(F.col("text")).alias("words"), F.round(T.token_count(F.col("text"), "chars4"), 6).alias("chars4"))


@query(r"SELECT doc_id, len(s)::INT AS sentences, length(s[1])::INT AS first_length FROM (SELECT doc_id, string_split(regexp_replace(text, '([.?!…])\s+', concat('\1', chr(1)), 'g'), chr(1)) AS s FROM documents)")
def sentence_split(t):
    return _documents(t).select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("sentences"), F.length(F.col("s")[0]).alias("first_length"))


#: Forms of lines, put before the documents' own lines by their number, in both dialects; some lines lose their end marks.
FORMS = ("- ", "# ", "    ", "1.2 ", "1.2. ", "Section 2.1 - ", "chapter iv: ", "IV. ", "2) ", "=== ", "### ", "")
BARE = (2, 3, 5, 6, 8, 9)
LINES = f"""SELECT doc_id, line_no, CASE WHEN line_no % 13 = 12 THEN translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
ELSE [{', '.join(map(repr, FORMS))}][(line_no % 13 % 12 + 1)::INT] || CASE WHEN line_no % 13 IN {BARE} THEN regexp_replace(line, '[.!?]', '', 'g') ELSE line END || CASE WHEN line_no % 13 = 9 THEN ' ===' ELSE '' END END AS line
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""


def _lines(t):
    rows = _documents(t).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    n, line = F.col("line_no") % 13, F.col("line")
    held = F.when(n.isin(*BARE), F.regexp_replace(line, "[.!?]", "")).otherwise(line)
    made = F.concat(F.element_at(F.array(*map(F.lit, FORMS)), (n % 12 + 1).cast("int")), held, F.when(n == 9, " ===").otherwise(""))
    return rows.select("doc_id", "line_no", F.when(n == 12, F.translate(line, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(made).alias("line"))


TITLED = r"(regexp_matches(t, '[\p{Lu}\p{Lt}]') AND NOT regexp_matches(t, '[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]|(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}'))"
LEVELS = rf"""WITH lines AS ({LINES}), s AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM lines),
seen AS (SELECT *, regexp_matches(t, '\p{{Lu}}') AND NOT regexp_matches(t, '[\p{{Ll}}\p{{Lt}}]') AS up, {TITLED} AS titled, length(t) < 80 AND t NOT LIKE '%.' AS short,
  length(regexp_extract(t, '{T.MARKED_TITLE}', 1)) AS marks, regexp_extract(t, '{T.ROMAN_TITLE}', 1) AS roman, regexp_extract(t, '{T.COUNTED_TITLE}', 1) AS counted,
  CASE WHEN regexp_matches(t, '{T.PLAIN_TITLE}') THEN 1 WHEN regexp_matches(t, '{T.CHAPTER_TITLE}') AND length(t) < 50 THEN 2 WHEN regexp_matches(t, '{T.CHAPTER_TITLE}') THEN 3 ELSE 0 END AS by_form FROM s),
pdf AS (SELECT *, CASE WHEN length(t) < 3 THEN 0 WHEN regexp_matches(t, '{T.NUMBERED}') THEN 1 ELSE by_form END AS pdf_level FROM seen)"""


@query(rf"""{LEVELS} SELECT doc_id, line_no::INT AS line_no, regexp_matches(line, '^\s*([-*•]|[0-9]+[.)])\s+') AS bullet, regexp_matches(line, '^\s*$') AS blank, length(regexp_extract(line, '^ *'))::INT AS indent, up AS upper,
regexp_matches(line, '{T.ENUMERATED_TITLE}') OR regexp_matches(line, '{T.PLAIN_TITLE}') OR regexp_matches(line, '{T.CHAPTER_TITLE}') AS formed, pdf_level,
CASE WHEN length(t) < 3 OR pdf_level > 0 THEN pdf_level WHEN short AND t NOT LIKE '%,' AND (up OR titled) THEN 2 WHEN regexp_matches(t, '{T.FENCED_TITLE}') THEN 1 ELSE marks END::INT AS txt_level,
CASE WHEN length(t) < 2 THEN 0 WHEN marks > 0 THEN marks WHEN roman <> '' AND regexp_matches(roman, '^M{{0,4}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})$') THEN 1
  WHEN counted <> '' THEN least(6, len(string_split(counted, '.')) + 1) WHEN up AND short THEN 2 ELSE by_form END::INT AS md_level FROM pdf""")
def line_classify(t):
    line = F.col("line")
    levels = [T.heading_level(line, rules).alias(f"{rules}_level") for rules in ("pdf", "txt", "md")]
    return _lines(t).select("doc_id", "line_no", line.rlike(T.BULLET).alias("bullet"), line.rlike(r"^\s*$").alias("blank"), T.indent_width(line).alias("indent"), T.is_upper(T.strip(line)).alias("upper"), T.is_heading_like(line).alias("formed"), *levels)


@query(f"WITH lines AS ({LINES}), heads AS (SELECT doc_id, line_no, length(regexp_extract(line, '^#+')) AS level, line FROM lines WHERE line LIKE '#%') SELECT a.doc_id, a.line_no::INT AS line_no, count(b.line_no)::INT AS depth FROM heads a LEFT JOIN heads b ON a.doc_id = b.doc_id AND b.line_no < a.line_no AND NOT EXISTS (SELECT 1 FROM heads c WHERE c.doc_id = b.doc_id AND c.line_no > b.line_no AND c.line_no < a.line_no AND c.level <= b.level) GROUP BY a.doc_id, a.line_no")
def heading_breadcrumbs(t):
    heads = _lines(t).where(F.col("line").startswith("#")).select("doc_id", F.struct(F.col("line_no").alias("block_index"), F.length(F.regexp_extract("line", "^#+", 0)).alias("level"), F.col("line").alias("text")).alias("h"))
    by_doc = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    return by_doc.select("doc_id", "hs", F.explode("hs").alias("h")).select("doc_id", F.col("h.block_index").alias("line_no"), F.size(C.breadcrumbs(F.col("hs"), F.col("h.block_index"))).alias("depth"))


#: Every third line of a document followed by an underline of its own, then a blank line: the block's first heading is the underlined line.
@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT doc_id, i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block FROM l WHERE regexp_matches(line, '\S'))
SELECT doc_id, block::INT AS block_index, CASE WHEN i % 2 = 0 THEN 1 ELSE 2 END AS level, md5(t) AS digest FROM b WHERE i % 3 = 0""")
def setext_lead(t):
    def marked(line, i):
        under = F.when(i % 3 == 0, F.concat(F.lit("\n"), F.repeat(F.when(i % 2 == 0, "=").otherwise("-"), (F.lit(1) + i % 5).cast("int")))).otherwise("")
        return F.when(line.rlike(r"\S"), F.concat(F.when(i % 3 == 0, line).otherwise(F.concat(F.lit("- "), line, F.lit("."))), under)).otherwise(line)

    text = F.array_join(F.transform(F.split("text", "\n"), marked), "\n\n")
    held = _documents(t).select("doc_id", F.explode(C.headings(C.blocks(text), "md")).alias("h"))
    return held.select("doc_id", "h.block_index", "h.level", F.md5(F.col("h.text").cast("binary")).alias("digest"))


#: The documents as fenced code: none of its lines is cut, so chunks hold as many lines as the code.
@query(r"SELECT doc_id, 2 + len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS lines, md5('```' || chr(10) || array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), chr(10)) || chr(10) || '```') AS digest FROM documents")
def fenced_code(t):
    code = F.array_join(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S")), "\n")
    chunks = C.chunk_documents(_documents(t).select("doc_id", F.concat(F.lit("```\n"), code, F.lit("\n```")).alias("text")), "md")
    held = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c")).select("doc_id", F.array_join(F.transform("c", lambda c: c["content"]), "\n").alias("text"))
    return held.select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("lines"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(r"""WITH RECURSIVE units AS (SELECT doc_id, i, greatest(1, len(list_filter(string_split_regex(s, '\s+'), lambda x: x <> ''))) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
fold AS (SELECT doc_id, i, n AS total, n > 120 AS shut, 0 AS grp FROM units WHERE i = 1
UNION ALL SELECT u.doc_id, u.i, CASE WHEN f.shut OR f.total + u.n > 120 THEN u.n ELSE f.total + u.n END, CASE WHEN f.shut THEN u.n > 120 ELSE f.total + u.n > 120 AND u.n >= 60 END, f.grp + CASE WHEN f.shut OR f.total + u.n > 120 THEN 1 ELSE 0 END FROM fold f JOIN units u ON u.doc_id = f.doc_id AND u.i = f.i + 1)
SELECT f.doc_id, f.grp::INT AS chunk_index, count(*) AS units, sum(u.n)::BIGINT AS tokens FROM fold f JOIN units u USING (doc_id, i) GROUP BY ALL""")
def greedy_pack(t):
    return C.grouped(_documents(t).select("doc_id", F.transform(F.split("text", "\n"), lambda s: T.token_count(s)).alias("sizes")), 60, 120)


@query(r"""WITH RECURSIVE lines AS (SELECT doc_id, i, CASE WHEN i % 5 = 4 THEN '' ELSE repeat(' ', 4 * (i % 3)) || s END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
marked AS (SELECT *, length(regexp_extract(line, '^ *')) AS ind, regexp_matches(line, '^\s*$') AS blank FROM lines),
fold AS (SELECT doc_id, i, CASE WHEN blank THEN NULL ELSE ind END AS ref, CASE WHEN blank THEN 0 ELSE 1 END AS blocks FROM marked WHERE i = 1 UNION ALL
SELECT m.doc_id, m.i, CASE WHEN m.blank THEN NULL WHEN f.ref IS NULL OR abs(m.ind - f.ref) >= 4 THEN m.ind ELSE f.ref END, f.blocks + CASE WHEN m.blank THEN 0 WHEN f.ref IS NULL OR abs(m.ind - f.ref) >= 4 THEN 1 ELSE 0 END FROM fold f JOIN marked m ON m.doc_id = f.doc_id AND m.i = f.i + 1)
SELECT doc_id, max(blocks)::INT AS blocks FROM fold GROUP BY doc_id""")
def block_split(t):
    made = F.transform(F.split("text", "\n"), lambda s, i: F.when((i + 1) % 5 == 4, F.lit("")).otherwise(F.concat(F.repeat(F.lit(" "), (4 * ((i + 1) % 3)).cast("int")), s)))
    return _documents(t).select("doc_id", F.size(C.blocks(F.array_join(made, "\n"))).alias("blocks"))


#: The documents have no blank or indented lines, so each is one block: whole up to 500 words, else its sentences are folded into pieces
#: and the pieces into chunks. grp counts the pieces (or chunks) that began; shut says that the last one takes no more.
CHUNKS = r"""WITH RECURSIVE count_of AS (SELECT doc_id, text, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents WHERE regexp_matches(text, '\S')),
sentence AS (SELECT doc_id, li, unnest(string_split(regexp_replace(line, '([.?!…])\s+', concat('\1', chr(1)), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(line, '([.?!…])\s+', concat('\1', chr(1)), 'g'), chr(1)), 1) AS si
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS li FROM count_of WHERE n > 500)),
part AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY li, si) AS i, trim(s) AS s, len(list_filter(string_split_regex(s, '\s+'), lambda x: x <> '')) AS n FROM sentence WHERE trim(s) <> ''),
piece_fold AS (SELECT doc_id, i, n AS total, n > 500 AS shut, 0 AS grp FROM part WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN NOT f.shut AND (f.total + p.n <= 500 OR (p.n > 500 AND f.total < 300)) THEN f.total + p.n ELSE p.n END, p.n > 500, f.grp + CASE WHEN NOT f.shut AND (f.total + p.n <= 500 OR (p.n > 500 AND f.total < 300)) THEN 0 ELSE 1 END
  FROM piece_fold f JOIN part p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
piece AS (SELECT doc_id, grp + 1 AS i, string_agg(s, chr(10) ORDER BY i) AS s, sum(n) AS n FROM piece_fold JOIN part USING (doc_id, i) GROUP BY doc_id, grp),
chunk_fold AS (SELECT doc_id, i, n AS total, n >= 300 AS shut, 0 AS grp FROM piece WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN NOT f.shut AND f.total + p.n <= 500 THEN f.total + p.n ELSE p.n END, CASE WHEN NOT f.shut AND f.total + p.n <= 500 THEN f.total + p.n ELSE p.n END >= 300, f.grp + CASE WHEN NOT f.shut AND f.total + p.n <= 500 THEN 0 ELSE 1 END
  FROM chunk_fold f JOIN piece p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
chunks AS (SELECT doc_id, grp AS chunk_index, sum(n) AS token_count, string_agg(s, chr(10) ORDER BY i) AS content FROM chunk_fold JOIN piece USING (doc_id, i) GROUP BY doc_id, grp
  UNION ALL SELECT doc_id, 0, n, text FROM count_of WHERE n <= 500)"""


@query(f"{CHUNKS} SELECT doc_id, chunk_index::INT AS chunk_index, token_count::INT AS token_count, md5(content) AS digest FROM chunks")
def chunk_documents(t):
    return C.chunk_documents(_documents(t)).select("doc_id", "chunk_index", "token_count", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"{CHUNKS} SELECT doc_id, count(*) AS chunks, sum(token_count)::BIGINT AS tokens, max(token_count)::INT AS longest FROM chunks GROUP BY doc_id")
def chunk_stats(t):
    return C.chunk_documents(_documents(t)).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("longest"))


#: Ends of lines by doc_id: leaders with and without spaces before a page number, names that end in digits, and none.
TOC_ENDS = (" ........ 12", " . . . . . . . . 7", " chapter 205", "part123")


@query(rf"""WITH docs AS (SELECT doc_id, replace(text, chr(10), coalesce([{', '.join(map(repr, TOC_ENDS))}][(doc_id % 7 + 1)::INT], '') || chr(10)) AS text FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS f FROM docs),
c AS (SELECT doc_id, f, len(f) AS n, len(list_filter(f, lambda x: regexp_matches(x, '\s[0-9]{{1,4}}$') AND length(x) > 15)) AS ends, len(list_filter(f, lambda x: len(string_split(x, '.')) > 8)) AS dots FROM l)
SELECT doc_id, (n >= 5 AND (len(list_filter(f[1:15], lambda x: contains(lower(x), 'table of contents') OR contains(lower(x), 'mục lục'))) > 0 OR (ends / n > 0.2 AND dots / n > 0.1) OR ends / n > 0.4)) AS is_toc FROM c""")
def toc_detect(t):
    end = F.coalesce(F.get(F.array(*map(F.lit, TOC_ENDS)), (F.col("doc_id") % 7).cast("int")), F.lit(""))
    return _documents(t).select("doc_id", T.is_toc_page(F.replace("text", F.lit("\n"), F.concat(end, F.lit("\n")))).alias("is_toc"))


@query(r"SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '[^A-Za-z0-9]+', '_', 'g'), '^_+', ''), '_+$', ''), 150) AS folder FROM pages")
def url_folder(t):
    return t("pages").select("page_id", T.url_folder(F.col("url")).alias("folder"))


@query(r"SELECT page_id, regexp_extract(regexp_replace(url, '^([a-z]+://[^/]*)/', '\1/docs/ns/kind/'), '/docs/([^?#]*)', 1) AS suffix FROM pages")
def techdocs_suffix(t):
    return t("pages").select("page_id", T.docs_suffix(F.regexp_replace("url", "^([a-z]+://[^/]*)/", "$1/docs/ns/kind/")).alias("suffix"))


@query(r"WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN regexp_replace(html, '(?is)<title[^>]*>.*?</title>', '') ELSE html END AS html FROM pages) SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), ''), '(untitled)') AS title FROM p")
def page_title(t):
    html = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("html", r"(?is)<title[^>]*>.*?</title>", "")).otherwise(F.col("html"))
    return t("pages").select("page_id", H.title(html).alias("title"))


@query("""SELECT page_id, len(u)::INT AS links, array_to_string(u, ' ') AS urls FROM (SELECT page_id, list_transform(list_filter(list_zip(x, range(1, len(x) + 1)), lambda z: list_position(x, z[1]) = z[2]), lambda z: z[1]) AS u FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS x FROM pages))""")
def page_links(t):
    return t("pages").select("page_id", H.links(F.col("html")).alias("u")).select("page_id", F.size("u").alias("links"), F.array_join("u", " ").alias("urls"))


#: Sources put before or in place of the pages by rule, so that each flag holds for some: a login, an application's root, a tiny page.
_SCRIPTS = "<script></script>" * 5


@query(rf"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN html || '<p>Log in</p>' WHEN 1 THEN '<div id="app"></div>{_SCRIPTS}' || html WHEN 2 THEN '<main>short</main>' WHEN 3 THEN '<p>TechDocs</p><noscript>x</noscript>' || html ELSE html END AS html, url || CASE WHEN page_id % 7 = 0 THEN '/OAuth/x' WHEN page_id % 7 = 1 THEN '?q=auth' ELSE '' END AS url FROM pages),
q AS (SELECT page_id, lower(html) AS low, lower(url) AS url, length(trim(regexp_replace(regexp_replace(regexp_replace(lower(html), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS bare FROM p)
SELECT page_id, url LIKE '%.pdf' AS is_pdf, low LIKE '%<html%' AS is_html, (regexp_matches(low, 'signin|log in|login|đăng nhập|authenticate|sso') OR string_split(string_split(url, '?')[1], '#')[1] LIKE '%://%/%auth%') AS looks_like_login,
  ((regexp_matches(low, '\sid="app"') OR (low LIKE '%<main>%' AND bare < 400) OR low LIKE '%<noscript%') AND (len(string_split(low, '<script')) > 5 OR bare < 300)) AS is_spa, (low LIKE '%backstage%' OR low LIKE '%techdocs%') AS is_backstage FROM q""")
def page_flags(t):
    kind, path = F.col("page_id") % 5, F.col("page_id") % 7
    html = F.when(kind == 0, F.concat("html", F.lit("<p>Log in</p>"))).when(kind == 1, F.concat(F.lit(f'<div id="app"></div>{_SCRIPTS}'), "html")).when(kind == 2, "<main>short</main>").when(kind == 3, F.concat(F.lit("<p>TechDocs</p><noscript>x</noscript>"), "html")).otherwise(F.col("html"))
    url = F.concat("url", F.when(path == 0, "/OAuth/x").when(path == 1, "?q=auth").otherwise(""))
    return t("pages").select("page_id", H.flags(html, url).alias("f")).select("page_id", "f.*")


#: The pages without bold marks, which stay open; some with a list and code at the end of their articles.
BLOCK_MORE = "<ul><li>one</li><li>two &amp; <a href='x'>three</a></li></ul><pre>a\n  b</pre></article>"


@query(r"""WITH held AS (SELECT page_id, regexp_extract(regexp_replace(html, '</?b>|<br>', '', 'g'), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
marked AS (SELECT page_id, string_split(replace(replace(a, '<h1>', chr(1) || 'h1' || chr(2)), '<p>', chr(1) || 'p' || chr(2)), chr(1))[2:] AS parts FROM held),
each AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM marked),
said AS (SELECT page_id, i, string_split(part, chr(2))[1] AS tag, regexp_replace(replace(replace(replace(replace(regexp_replace(string_split(part, chr(2))[2], '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS text FROM each),
full_ AS (SELECT * FROM said WHERE text <> '' UNION ALL SELECT page_id, 100000 + k, ['ul', 'pre'][k::INT], ['- one' || chr(10) || '- two & three', 'a' || chr(10) || '  b'][k::INT] FROM pages, range(1, 3) r(k) WHERE page_id % 3 = 0)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS block_no, tag, md5(text) AS digest FROM full_""")
def page_blocks(t):
    html = F.regexp_replace("html", "</?b>|<br>", "")
    more = F.when(F.col("page_id") % 3 == 0, F.replace(html, F.lit("</article>"), F.lit(BLOCK_MORE))).otherwise(html)
    return H.page_blocks(_pages(t).select("page_id", more.alias("html"))).select("page_id", "block_no", "tag", F.md5(F.col("text").cast("binary")).alias("digest"))


#: The pages with their articles called by no known name and two more paragraphs in them: the prose is found by density.
PROSE = "".join(f"<p>{'A sentence of prose that is long enough to count as such in any page. ' * 2}{n}</p>" for n in ("first", "second"))


@query(rf"""WITH held AS (SELECT page_id, regexp_extract(regexp_replace(html, '</?b>|<br>', '', 'g'), '(?s)<article>(.*)</article>', 1) || '{PROSE}' AS a FROM pages),
parts AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(a, '(?s)<[^>]*>', chr(1), 'g'), chr(1)), lambda x: regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM held)
SELECT page_id, md5(regexp_replace(array_to_string(p, ' '), '\s+', ' ', 'g')) AS digest FROM parts""")
def page_dense_text(t):
    html = F.regexp_replace("html", "</?b>|<br>", "")
    plain = F.replace(F.replace(html, F.lit("<article>"), F.lit('<div class="x1"><div>')), F.lit("</article>"), F.lit(f"{PROSE}</div></div>"))
    made = H.dense_texts(_pages(t).select("page_id", plain.alias("html")))
    return made.select("page_id", F.md5(F.trim(F.regexp_replace("text", r"\s+", " ")).cast("binary")).alias("digest"))


CITED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\s*\[[0-9]+\]', '', 'g'), '\s*\^\s*', ' ', 'g'), '(?i)\s*\(link\)\s*', ' ', 'g'), '\s{{2,}}', ' ', 'g')"
#: The pages with a section of references, a citation, two pictures and a table put into their articles by rule.
PAGE_MORE = ("<sup class=\"reference\">[3]</sup>", "<img srcset=\"/a.png 1w, /b.png 2w\" src=\"/c.png\"><img data-original=\"d.png\">", "<table><tr><td>cell</td></tr></table>", "<h2>Notes</h2><p>gone</p>")


@query(rf"""WITH held AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS a FROM pages),
parts AS (SELECT page_id, url, list_filter(list_transform(string_split(regexp_replace(a, '(?s)<[^>]*>', chr(1), 'g'), chr(1)), lambda x: regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM held),
clean AS (SELECT page_id, url, trim(array_to_string(list_filter(list_transform(string_split(regexp_replace(array_to_string(p, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: NOT regexp_matches(x, '^(Archived from the original|Retrieved)')), chr(10))) AS t FROM parts),
done AS (SELECT page_id, url, {CITED.format('t')} AS t FROM clean)
SELECT page_id, md5(t) AS digest, length(t) >= 200 AS is_article, regexp_extract(url, '^[a-z]+://[^/]*') || '/b.png ' || regexp_extract(url, '^([a-z]+://.*/)[^/]*$', 1) || 'd.png' AS images FROM done""")
def page_main_text(t):
    html = F.regexp_replace("html", "</article>", "".join(PAGE_MORE) + "</article>")
    return H.main_texts(dealt(t("pages")).withColumn("html", html)).select("page_id", F.md5(F.col("main_text").cast("binary")).alias("digest"), "is_article", F.array_join("image_urls", " ").alias("images"))


#: Lines that name archives and retrievals stand before, within and after the texts.
@query(r"WITH d AS (SELECT doc_id, 'Archived from the original' || chr(10) || replace(text, '. ', '.   ' || chr(10) || chr(10) || chr(10) || '  Retrieved in May' || chr(13) || chr(10) || 'Not Retrieved ') || chr(13) || 'Retrieved' AS text FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents)), u AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM d) SELECT doc_id, md5(trim(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: NOT regexp_matches(x, '^(Archived from the original|Retrieved)')), chr(10)))) AS digest FROM u")
def whitespace_clean(t):
    told = F.replace("text", F.lit(". "), F.lit(".   \n\n\n  Retrieved in May\r\nNot Retrieved "))
    text = F.concat(F.lit("Archived from the original\n"), told, F.lit("\rRetrieved"))
    return _documents(t).select("doc_id", F.md5(T.clean_whitespace(text).cast("binary")).alias("digest"))


@query(r"SELECT doc_id, md5(string_split_regex(CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(10) || 'REFERENCES' || chr(10)) WHEN 1 THEN replace(text, '. ', '. References ') ELSE text END, '(?i)\n(?:References|Bibliography|Notes|Footnotes)\n')[1]) AS digest FROM documents")
def references_cut(t):
    kind = F.col("doc_id") % 3
    text = F.when(kind == 0, F.replace("text", F.lit("\n"), F.lit("\nREFERENCES\n"))).when(kind == 1, F.replace("text", F.lit(". "), F.lit(". References "))).otherwise(F.col("text"))
    return t("documents").select("doc_id", F.md5(T.without_references(text).cast("binary")).alias("digest"))


#: A line break that stands alone: the pattern takes its neighbours along, so it goes over the text twice.
JOINED = r"regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g')"
FLOWED = rf"regexp_replace(regexp_replace({JOINED}, '(^|[^\n])\n([^\n]|$)', '\1 \2', 'g'), '(^|[^\n])\n([^\n]|$)', '\1 \2', 'g')"


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace({FLOWED}, '[ \t]{{2,}}', ' ', 'g'), ' +([,.;:!?)])', '\1', 'g')) AS digest FROM documents")
def linebreak_fix(t):
    return _documents(t).select("doc_id", F.md5(T.fix_linebreaks(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5({CITED.format("text || ' a[1] b^ (Link) c' || chr(10) || ' [22]'")}) AS digest FROM documents")
def citations_strip(t):
    return _documents(t).select("doc_id", F.md5(T.strip_citations(F.concat("text", F.lit(" a[1] b^ (Link) c\n [22]"))).cast("binary")).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' ![x](http://y/z.png) ![a][b] <img src=q>' || repeat(chr(10), 4) || 'end', '!\[[^\]]*\]\([^)]*\)', '', 'g'), '!\[[^\]]*\]\[[^\]]*\]', '', 'g'), '(?i)<img[^>]*>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents")
def md_clean(t):
    return _documents(t).select("doc_id", F.md5(T.clean_markdown(F.concat("text", F.lit(" ![x](http://y/z.png) ![a][b] <img src=q>\n\n\n\nend"))).cast("binary")).alias("digest"))


@query("SELECT count(*) AS n, sum(length(text))::BIGINT AS chars, count(DISTINCT source) AS files FROM documents")
def store_stats(t):
    return S.stats(t("documents"))


@query("SELECT source, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source")
def last_per_key(t):
    return S.last_per_key(t("documents"), "source", "lang", "doc_id")


@query("SELECT coalesce(CASE WHEN kind IN ('pdf', 'txt', 'md', 'docx', 'xlsx') THEN kind END, 'unsupported') AS file_type, count(*) AS n, md5(string_agg(name, ',' ORDER BY name)) AS files FROM (SELECT 'd' || doc_id || '.' || ['PDF', 'txt', 'md', 'docx', 'xlsx', 'bin', 'x.md'][(doc_id % 7)::INT + 1] AS name, lower(['PDF', 'txt', 'md', 'docx', 'xlsx', 'bin', 'md'][(doc_id % 7)::INT + 1]) AS kind FROM documents) GROUP BY file_type")
def group_files(t):
    ending = F.element_at(F.array(*map(F.lit, ("PDF", "txt", "md", "docx", "xlsx", "bin", "x.md"))), (F.col("doc_id") % 7 + 1).cast("int"))
    paths = t("documents").select(F.concat(F.lit("file:/folder/sub/d"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("path"))
    return readers.grouped_files(paths).withColumn("files", F.md5(F.array_join("files", ",").cast("binary")))


@query("SELECT doc_id, text FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def insert_new_only(t):
    return S.insert_new_only(t("labels"), t("documents"), "doc_id").select("doc_id", "text")


def _store(rows):
    """A store of its own in the workspace that holds rows (id, file_name, ...)."""
    spark = rows.sparkSession
    store = S.ChunkStore(spark, S.workspace(spark))
    store.insert(rows)
    return store


@query("SELECT doc_id, source, lang, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents ORDER BY doc_id LIMIT 5")
def store_samples(t):
    return S.samples(t("documents").select(F.col("doc_id").alias("id"), "source", "lang", F.col("text").alias("content"))).withColumnRenamed("id", "doc_id")


@query("SELECT doc_id, source, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE upper(lang) || text END) AS digest FROM documents")
def store_insert(t):
    rows = t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_name"), "text", "lang")
    store = _store(rows.where("id % 2 = 0"))
    store.insert(rows.withColumn("text", F.concat(F.upper("lang"), "text")))  # every other row is there already and stays
    return store.read().select(F.col("id").alias("doc_id"), F.col("file_name").alias("source"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id, n_chars, md5(text) AS digest FROM documents WHERE source IN ('src3', 'src11')")
def store_file_chunks(t):
    store = _store(t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_name"), "text", "n_chars"))
    return store.of_files(["src3", "src11", "none"]).select(F.col("id").alias("doc_id"), "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id FROM documents WHERE source IS DISTINCT FROM 'src3'")
def delete_by_key(t):
    store = _store(t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_name"), "text"))
    store.delete_file("src3")
    return store.read().select(F.col("id").alias("doc_id"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE source IN ('src1', 'src2') AND n_chars >= 500 AND n_chars <= 2000 AND lang = 'en' AND doc_id <> 7")
def metadata_filter(t):
    where = {"$and": [{"source": {"$in": ["src1", "src2"]}}, {"n_chars": {"$gte": 500, "$lte": 2000}}, {"lang": "en"}, {"doc_id": {"$ne": 7}}]}
    return t("documents").where(R.matches(where)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


#: Two rank lists of which neither holds all of the other: by length and by number.
RANKS = "a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE doc_id % 4 <> 0)"


@query(f"WITH {RANKS} SELECT coalesce(a.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 9) AS rrf_score FROM a FULL JOIN b ON a.id = b.id")
def rrf_outer(t):
    rows = t("documents").select(F.col("doc_id").alias("id"), "n_chars")
    a = numbered(rows.where("id % 3 <> 0"), [F.desc("n_chars"), "id"])
    b = numbered(rows.where("id % 4 <> 0"), ["id"])
    return R.fuse_lists([a.select("id", "rank"), b.select("id", "rank")]).select("id", F.round("rrf_score", 9).alias("rrf_score"))


@query("SELECT a.conv_id, a.turn, count(b.turn) AS pictures, coalesce(array_to_string(list(b.turn ORDER BY b.turn), ','), '') AS held FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn % 2 = 0 AND b.turn IN (a.turn, a.turn + 2) GROUP BY ALL")
def chunk_pictures(t):
    rows = t("conversations")
    chunks = rows.select("conv_id", "turn", F.array(F.col("turn"), F.col("turn") + 2).alias("block_indices"))
    made = readers.pictures_of_chunks(chunks, rows.where("turn % 2 = 0").select("conv_id", F.col("turn").alias("paragraph"), F.col("turn").alias("picture")), "conv_id", "turn", "block_indices", "paragraph", "picture")
    return made.select("conv_id", "turn", F.size("pictures").cast("bigint").alias("pictures"), F.array_join("pictures", ",").alias("held"))


@query("SELECT a.l_orderkey, a.l_linenumber AS picture, count(b.l_linenumber) AS blocks, coalesce(sum(b.l_quantity), 0) AS quantity FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber <> a.l_linenumber AND (abs((b.l_quantity + 10) - a.l_quantity) < 5 OR abs(b.l_quantity - (a.l_quantity + 10)) < 5) GROUP BY a.l_orderkey, a.l_linenumber")
def picture_margin(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("top"), (F.col("l_quantity") + 10).alias("bottom"))
    near = readers.within_margin(rows, rows, "l_orderkey", 5.0)
    kept = F.col("n_l_linenumber") != F.col("l_linenumber")
    return near.groupBy("l_orderkey", F.col("l_linenumber").alias("picture")).agg(F.count(F.when(kept, 1)).alias("blocks"), F.coalesce(F.sum(F.when(kept, F.col("n_top"))), F.lit(0.0)).alias("quantity"))


#: Documents as pictures: their source the file, their language the page, their type the part of their number.
@query("SELECT file_name, page_number, format, count(*) AS images, sum(n_chars)::BIGINT * 1024 AS bytes, count(*) FILTER (WHERE n_chars > 1024) AS large FROM (SELECT source AS file_name, (doc_id % 7)::INT AS page_number, lang AS format, n_chars FROM documents WHERE doc_id % 5 <> 0) GROUP BY GROUPING SETS ((file_name, page_number), (format), ())")
def grouping_sets_summary(t):
    bad = F.when(F.col("doc_id") % 5 == 0, "unreadable")
    pictures = t("documents").select(F.col("source").alias("file_name"), (F.col("doc_id") % 7).cast("int").alias("page_number"), F.col("lang").alias("format"), (F.col("n_chars") * 1024).alias("size_bytes"), bad.alias("error"))
    return readers.image_summary(pictures).select("file_name", "page_number", "format", "images", "bytes", "large")


@query("SELECT a.l_orderkey, a.l_linenumber AS line, b.l_linenumber AS near, b.l_quantity AS quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) <= 3")
def band_join_rows(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return near_rows(rows.select("l_orderkey", "l_linenumber"), rows, "l_orderkey", "l_linenumber", 3).select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("n_l_linenumber").alias("near"), F.col("n_l_quantity").alias("quantity"))


@query(r"WITH c AS (SELECT conv_id, turn, text || ' [''http://a/' || turn || ''', ''http://b/x'']' AS text FROM conversations) SELECT conv_id, turn, trim(left(text, length(text) - length(regexp_extract(text, '(?s)\[\s*[''\"]https?://[^\]]*\]\s*$')))) AS answer, array_to_string(regexp_extract_all(regexp_extract(text, '(?s)\[\s*[''\"]https?://[^\]]*\]\s*$'), 'https?://[^''\"\s,\]]+'), ' ') AS urls FROM c")
def answer_split(t):
    made = F.concat("text", F.lit(" ['http://a/"), F.col("turn").cast("string"), F.lit("', 'http://b/x']"))
    return t("conversations").select("conv_id", "turn", T.answer_and_urls(made).alias("a")).select("conv_id", "turn", F.col("a.text").alias("answer"), F.array_join("a.urls", " ").alias("urls"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'irrelevant' WHEN 2 THEN 'suggestion' ELSE 'unknown' END AS route FROM conversations")
def route(t):
    made = F.concat(F.element_at(F.array(*map(F.lit, ("VALID: ", "IRRELEVANT: ", "SUGGESTION: ", "Error "))), (F.col("turn") % 4 + 1).cast("int")), F.col("text"))
    return t("conversations").select("conv_id", "turn", T.route(made).alias("route"))


@query(rf"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split('1. ' || replace(text, '. ', '?' || chr(10) || '- '), chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '\?|^[0-9]+[.)]|^[-*•]')) AS x FROM conversations),
b AS (SELECT conv_id, turn, list_filter(list_transform(x, lambda y: trim(regexp_replace(regexp_replace(y, '^[0-9]+[.)]\s*', ''), '[-*•]', '', 'g'))), lambda y: y <> '') AS x FROM l),
d AS (SELECT conv_id, turn, list_transform(list_filter(list_zip(x, range(1, len(x) + 1)), lambda z: list_position(x, z[1]) = z[2]), lambda z: z[1])[1:4] AS x FROM b)
SELECT conv_id, turn, array_to_string(list_concat(x, [{', '.join(map(repr, DEFAULTS))}][len(x) + 1:4]), '|') AS questions FROM d""")
def questions_parse(t):
    made = F.concat(F.lit("1. "), F.replace("text", F.lit(". "), F.lit("?\n- ")))
    return t("conversations").select("conv_id", "turn", F.array_join(T.questions(made, DEFAULTS), "|").alias("questions"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_window_counts(t):
    return event_windows(t("events")).withColumn("total", F.round("total", 4))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/api/techdocs/static/docs/ns/kind/n' || page_id || '/index.html' END AS static_url FROM pages")
def techdocs_static(t):
    tail = F.when(F.col("page_id") % 3 == 0, "/docs/ns/kind").otherwise(F.concat(F.lit("/en/docs/ns/kind/n"), F.col("page_id").cast("string"), F.lit("/deep?q=docs")))
    return t("pages").select("page_id", T.techdocs_url(F.concat(F.regexp_extract("url", "^([a-z]+://[^/]*)", 1), tail)).alias("static_url"))


@query("SELECT page_id, CASE WHEN page_id % 500 > 250 THEN 'http://h/b.png' ELSE 'http://h/c.png' END AS best FROM pages")
def srcset_widest(t):
    candidates = F.concat(F.lit("http://h/a.png 100w, http://h/b.png "), (F.col("page_id") % 500).cast("string"), F.lit("w, http://h/c.png 250w, http://h/d.png"))
    return t("pages").select("page_id", H.widest(candidates).alias("best"))


@query("SELECT user_id, event_type, 'sid,' || event_type || (CASE WHEN user_id % 2 = 0 THEN ',u' || user_id ELSE '' END) AS names FROM events GROUP BY ALL")
def cookie_names(t):
    held = t("events").select("user_id", "event_type").distinct()
    header = F.concat(F.lit("sid=1; Path=/, "), F.col("event_type"), F.lit("=2; Secure, sid=3"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(", u"), F.col("user_id").cast("string"), F.lit("=4"))).otherwise(", plain"))
    return held.select("user_id", "event_type", F.array_join(T.cookie_names(header), ",").alias("names"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN NULL WHEN turn % 4 = 1 THEN turn::VARCHAR ELSE turn || '-' || (turn + turn % 4) END AS page_range,
CASE WHEN role = 'user' THEN 'Unknown' ELSE role END AS file_name, CASE WHEN turn % 3 = 0 THEN -1 ELSE turn END AS chunk_index, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview,
md5(CASE WHEN turn % 2 = 0 THEN '[Context: ' || role || ' > ' || conv_id || ']' || chr(10) || chr(10) || text ELSE text END) AS payload FROM conversations""")
def hit_projection(t):
    turn = F.col("turn")
    first, last = F.when(turn % 4 != 0, turn), F.when(turn % 4 == 1, turn).otherwise(turn + turn % 4)
    crumbs = F.when(turn % 2 == 0, F.array("role", F.col("conv_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    hits = t("conversations").select("conv_id", "turn", F.when(F.col("role") != "user", F.col("role")).alias("file_name"), F.col("text").alias("content"), first.alias("page_from"), last.alias("page_to"), crumbs.alias("breadcrumbs"), F.when(turn % 3 != 0, turn).alias("chunk_index"))
    return R.shown(hits).select("conv_id", "turn", "page_range", "file_name", "chunk_index", "preview", F.md5(F.col("payload").cast("binary")).alias("payload"))


@query("SELECT a.conv_id, a.turn, b.turn AS image, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn AND a.turn + a.turn % 3")
def range_join_pages(t):
    c = t("conversations")
    spans = c.select("conv_id", "turn", (F.col("turn") + F.col("turn") % 3).alias("last"))
    return readers.in_range(spans, c.select("conv_id", "turn", "role"), "conv_id", "turn", "last", "turn").select("conv_id", "turn", F.col("p_turn").alias("image"), F.col("p_role").alias("role"))


def _context_sql(own: str) -> str:
    return f"SELECT conv_id, turn, md5(array_to_string(list_filter(coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING{own}), []), lambda x: trim(x) <> ''), chr(10) || chr(10))) AS digest FROM conversations"


def _context(t, own: bool):
    rows = t("conversations").select("conv_id", "turn", "text")
    return readers.surroundings(rows, "conv_id", "turn", "text", own=own).select("conv_id", "turn", F.md5(F.col("context").cast("binary")).alias("digest"))


@query(_context_sql(" EXCLUDE CURRENT ROW"))
def image_context_paragraphs(t):
    return _context(t, False)


@query(_context_sql(""))
def image_context_rows(t):
    return _context(t, True)


@query("SELECT conv_id, turn, [0, 3, 7][least((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // greatest(1, count(*) OVER (PARTITION BY conv_id) // 3), 2)::INT + 1]::INT AS paragraph FROM conversations")
def image_distribution(t):
    held = t("conversations").select("conv_id", "turn")
    return readers.dealt_images(held, "conv_id", "turn", F.array(F.lit(0), F.lit(3), F.lit(7))).select("conv_id", "turn", "paragraph")


@query("SELECT c_custkey, array_to_string(list_filter([c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_nationkey::VARCHAR END], lambda x: x IS NOT NULL AND trim(x) <> ''), ' | ') AS line FROM customer")
def row_text(t):
    key = F.col("c_custkey")
    return t("customer").select("c_custkey", T.row_text(F.array("c_name", F.when(key % 2 == 0, F.col("c_mktsegment")), F.when(key % 3 == 0, " ").otherwise(F.col("c_nationkey").cast("string")))).alias("line"))


#: A workbook by market segment: a row a customer, of whose cells some are blank, a column without any, and a sheet without rows.
@query("SELECT c_mktsegment AS sheet, count(*) AS n_rows, max(CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 2 END) AS n_columns, false AS is_empty FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'blank', 0, 0, true")
def sheet_info(t):
    row = F.array(F.col("c_name"), F.lit(" "), F.col("c_acctbal").cast("string"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")))
    cells = t("customer").select(F.col("c_mktsegment").alias("sheet"), F.col("c_custkey").alias("row_idx"), F.posexplode(row).alias("col_idx", "value"))
    blank = cells.sparkSession.createDataFrame([("blank", None, None, None)], "sheet string, row_idx long, col_idx int, value string")
    return readers.sheet_info(cells.unionByName(blank))


@query("SELECT page_id, base || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '.png' AS name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS n FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://([^/]*)', 1), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+', ''), '_+$', '') AS base FROM pages))")
def unique_image_names(t):
    held = t("pages").select("page_id", T.file_base(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)).alias("base"), T.image_ending(F.lit("image/png")).alias("ending"))
    return readers.unique_names(held, "base", "ending", "page_id").select("page_id", "name")


@query("SELECT source AS file_name, count(*) AS chunks, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id) FILTER (WHERE n <= 100)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) GROUP BY source")
def document_summary(t):
    rows = t("documents").select(F.col("source").alias("file_name"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"))
    return S.summaries(rows).select("file_name", "chunks", F.md5(F.col("contents").cast("binary")).alias("digest"))
