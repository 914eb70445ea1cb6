"""The engine's verbs over one chunk store: list, process, search, answer, suggest, delete. Models are injected by the caller."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import prompts
from tessella.functions import text as T
from tessella.operators import chunking, retrieval
from tessella.operators.ann import VectorIndex
from tessella.operators.postings import Postings
from tessella.operators.store import ChunkStore, samples, summaries, workspace
from tessella.sources import files

DIMENSIONS, SUMMARY_CHUNKS = 64, 100
#: Summaries that the model folds into one at a time.
FOLD = 20
#: File names up to which the store is looked up by name.
MOST_NAMES = 1000
IMAGE_MARK = r"(?m)^\[IMAGE: .* - [0-9]+x[0-9]+\]$|^\[Image-only paragraph\]$"
NO_DOCUMENTS = "No relevant documents found for your query."
DEFAULTS = ("What are the main topics of the documents?", "Which terms are explained?", "Which steps are described?", "What else is covered?")


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A stand-in for an embedding model: the counts of hashed words, at unit length; zeros for a text without words."""
    places = F.transform(T.bm25_tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)))
    counts = F.transform(F.array(places), lambda p: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(p, lambda x: x == d)).cast("double")))[0]
    return F.transform(F.array(counts), lambda c: F.transform(c, lambda x: x / F.greatest(F.lit(1e-12), F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y)))))[0]


class Engine:
    """embed: text column to vector column. model: (prompt name, prompt) to a reply; the prompts are those of functions.prompts, filled.
    Without a model questions count as valid, answers are the contents and summaries are each file's first text.

    Beside the store lie an index of its vectors and one of its words, which take up what the store has new before they are searched."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] = hashed_embedding, model: Callable[[str, str], str] | None = None):
        self.spark, self.store, self.embed, self.model = spark, ChunkStore(spark, path), embed, model
        self.vectors, self.words = VectorIndex(spark, f"{self.store.path}/vectors"), Postings(spark, f"{self.store.path}/words")

    def sync(self) -> None:
        """Brings the indexes up to the store: new parts are added, and where the store was compacted they are made anew."""
        parts = self.store.parts()
        for index, columns in ((self.vectors, lambda rows: rows.drop("content")), (self.words, lambda rows: rows.select("id", "file_name", "content"))):
            seen = index.table.state()["notes"].get("seen", [])
            if set(seen) - set(parts):
                index.rebuild(columns(self.store.read()), {"seen": parts})
            elif new := [p for p in parts if p not in seen]:
                index.add(columns(self.store.rows_of(new)), {"seen": parts})

    def list_files(self, folder: str) -> DataFrame:
        return files.listed(self.spark, folder)

    def _records(self, docs: DataFrame, least: int, most: int) -> DataFrame:
        made = chunking.chunk_documents(docs.where("error is null"), "txt", least, most, ("path", "doc_id", "file_name", "file_type"))
        return made.select(
            F.concat_ws("_", "file_name", F.left(F.md5(F.col("path").cast("binary")), F.lit(12)), "chunk_index").alias("id"), "path", "doc_id", "file_name", "file_type", "chunk_index", "content", "token_count", "breadcrumbs",
            F.try_element_at("breadcrumbs", F.lit(-1)).alias("section_title"), F.when(F.size("breadcrumbs") > 0, F.array_join("breadcrumbs", " > ")).alias("heading_path"),
            "indent_levels", "page_from", "page_to", T.page_range(F.col("page_from"), F.col("page_to")).alias("page_range"), self.embed(F.col("content")).alias("embedding"),
        )

    def process(self, folder: str, least: int = chunking.MIN_TOKENS, most: int = chunking.MAX_TOKENS) -> DataFrame:
        """Read, chunk and store a folder or a file; chunks whose id the store has stay as they are. The state of each file: files are
        known by their paths. They are read and parsed once; their texts wait in the workspace."""
        path = workspace(self.spark)
        files.read(self.spark, folder, with_images=True).write.parquet(path)
        docs = self.spark.read.parquet(path)
        self.store.insert(self._records(docs, least, most))
        self.sync()
        names = [r["file_name"] for r in docs.select("file_name").distinct().limit(MOST_NAMES + 1).collect()]
        held = self.store.of_files(names) if len(names) <= MOST_NAMES else self.chunks()
        kept = held.groupBy("path").agg(F.count("*").alias("chunks_stored"), F.sum("token_count").alias("total_tokens"))
        pictures = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(IMAGE_MARK), F.lit(0)))
        found = docs.select("path", "file_name", "file_type", "error", pictures.alias("image_count")).join(kept, "path", "left")
        stored, tokens = F.coalesce("chunks_stored", F.lit(0)), F.coalesce("total_tokens", F.lit(0))
        done = F.col("error").isNull() & (stored > 0)
        message = F.when(F.col("error").isNotNull(), F.concat(F.lit("not read: "), "error")).when(stored == 0, "no text found").otherwise(F.concat(F.lit("stored chunks: "), stored.cast("string")))
        return found.select("file_name", "file_type", done.alias("success"), message.alias("message"), stored.alias("chunks_stored"), tokens.alias("total_tokens"), (F.col("image_count") > 0).alias("has_images"), "image_count", "error")

    def chunks(self) -> DataFrame:
        """All stored chunks; an empty table of the same columns before the first insert."""
        now = self.store.read()
        if now is not None:
            return now
        none = self.spark.createDataFrame([], "path string, file_name string, doc_id string, file_type string, text string, error string")
        return self._records(none, chunking.MIN_TOKENS, chunking.MAX_TOKENS)

    def file_chunks(self, file_name: str) -> DataFrame:
        now = self.store.file_chunks(file_name)
        return self.chunks() if now is None else now

    def delete_file(self, file_name: str) -> int:
        n = self.store.delete_file(file_name)
        if n:
            self.vectors.forget(file_name)
            self.words.forget(file_name)
        return n

    def clear(self) -> int:
        n = self.chunks().count()
        for one in (self.store, self.vectors, self.words):
            one.clear()
        return n

    def stats(self) -> DataFrame:
        return self.chunks().agg(F.count("*").alias("chunks"), F.countDistinct("file_name").alias("files"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))

    def samples(self, n: int = 5) -> DataFrame:
        """The first chunks by id as previews with all that is known of them, embeddings left out."""
        return samples(self.chunks().drop("embedding"), n)

    def search(self, question: str, k: int = retrieval.TOP_K, window: int = 2, min_similarity: float = 0.0, where: dict | None = None, exact: bool = False) -> DataFrame:
        """Chunks around the k nearest of those that where (see retrieval.matches) allows, in the order of documents; none for a blank
        question."""
        hits = self.hits(question, k, min_similarity, where, exact)
        near = hits.select("doc_id", "chunk_index", "file_name").collect()  # at most MOST_K rows
        rows = self.store.of_files([r["file_name"] for r in near]) if near else self.chunks().limit(0)
        held = self.spark.createDataFrame([tuple(r)[:2] for r in near], "doc_id string, chunk_index int")
        return retrieval.expanded(held, rows, window).orderBy("doc_id", "chunk_index")

    def _found(self, near: DataFrame | None, extra: str, order: list) -> DataFrame:
        """The stored chunks of near (id, file_name, a score named extra), at most MOST_K rows, with the score and its rank."""
        rows = near.select("id", "file_name", extra).collect() if near is not None else []
        held = self.store.of_files([r["file_name"] for r in rows]) if rows else self.chunks().limit(0)
        scored = F.broadcast(self.spark.createDataFrame([tuple(r) for r in rows], f"_id string, _file string, {extra} double"))
        both = held.join(scored, (F.col("id") == F.col("_id")) & F.col("file_name").eqNullSafe(F.col("_file"))).drop("_id", "_file")
        return both.withColumn("vector_rank", F.row_number().over(Window.orderBy(*order)))

    def hits(self, question: str, k: int = retrieval.TOP_K, min_similarity: float = 0.0, where: dict | None = None, exact: bool = False) -> DataFrame:
        """The k nearest chunks of those that where allows, with distance, similarity and vector_rank, by the index of vectors: of the lists
        that it visits, or exact."""
        self.sync()
        asked = self.spark.createDataFrame([(question,)], "q string").select(self.embed(F.col("q")).alias("v")).first()["v"]  # one row
        near = self.vectors.nearest(asked, min(k, retrieval.MOST_K), where, exact) if question.strip() else None
        similarity = F.greatest(F.lit(0.0), 1 - F.col("distance"))
        return self._found(near, "distance", ["distance", "id"]).withColumn("similarity", similarity).where(F.col("similarity") >= min_similarity)

    def keyword_hits(self, question: str, k: int = retrieval.TOP_K) -> DataFrame:
        """The k best chunks by BM25 over the whole store, with bm25_score and word_rank, by the postings of the question's words."""
        self.sync()
        return self._found(self.words.search(question, min(k, retrieval.MOST_K)), "bm25_score", [F.desc("bm25_score"), "id"]).withColumnRenamed("vector_rank", "word_rank")

    def rerank(self, question: str, scorer: Callable[[Column], Column] | None = None, per_file: int = retrieval.PER_FILE) -> DataFrame:
        """Hits by vectors and BM25, fused, re-ranked, without repeated contents, at most per_file of a file."""
        return retrieval.postprocess(retrieval.rerank(self.hits(question, retrieval.MOST_K), question, scorer), per_file)

    def _ask(self, name: str, **values: str) -> str:
        return self.model(name, prompts.render(name, **values))

    def query(self, question: str) -> dict:
        """success, response or error, image links, and the number of chunks found. The question is judged by the summaries of all files,
        answered from the chunks found."""
        found = self.search(question).select("file_name", "content").collect()  # at most k * (2 * window + 1) chunks
        if not found:
            return {"success": True, "response": NO_DOCUMENTS, "images": [], "chunks_found": 0}
        contents = "\n\n".join(f"[{r['file_name']}] {r['content']}" for r in found)
        verdict = self._ask("validate", summaries=self.digest(), question=question) if self.model else f"VALID: {question}"
        reply = self._ask("answer", contents=contents, question=verdict.partition(":")[2].strip()) if self.model and verdict.startswith("VALID") else contents
        one = self.spark.createDataFrame([(verdict, reply)], "verdict string, reply string").select(T.route(F.col("verdict")).alias("route"), T.answer_and_urls(F.col("reply")).alias("a")).first()
        if one["route"] == "valid":
            return {"success": True, "response": one["a"]["text"], "images": one["a"]["urls"], "chunks_found": len(found)}
        return {"success": False, "error": verdict.partition(":")[2].strip() or verdict, "images": [], "chunks_found": 0 if one["route"] == "irrelevant" else len(found)}

    def summaries(self) -> DataFrame:
        """(file_name, summary): each file's first chunks, through the model where there is one, in batches of rows."""
        texts = summaries(self.chunks(), SUMMARY_CHUNKS)
        if self.model is None:
            return texts.select("file_name", T.preview(F.col("contents"), 500).alias("summary"))
        model = self.model

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                said = [model("summary", prompts.render("summary", file_name=n, contents=c)) for n, c in zip(pdf["file_name"], pdf["contents"], strict=True)]
                yield pd.DataFrame({"file_name": pdf["file_name"], "summary": said})

        return texts.select("file_name", "contents").mapInPandas(run, "file_name string, summary string")

    def digest(self) -> str:
        """The summaries of all files as one text: FOLD at a time the model makes one of them, on the executors, until one round leaves at
        most FOLD. It is kept beside the store until the store changes."""
        version = self.store.table.state()["version"]
        kept = f"{self.store.path}/digests/{version}"
        place = self.store.table._jvm_path(kept)
        if not self.store.table._fs.exists(place):
            line = F.concat_ws(": ", "file_name", "summary").alias("text")
            self._folded(self.summaries().select(F.col("file_name").alias("key"), line)).write.mode("overwrite").parquet(kept)
        rows = self.spark.read.schema("key string, text string").parquet(kept).orderBy("key").collect()  # at most FOLD rows
        return "\n\n".join(r["text"] for r in rows)

    def _folded(self, rows: DataFrame) -> DataFrame:
        """rows (key, text) folded to at most FOLD of them: in every round, groups of about FOLD by a hash of their keys become one text."""
        model = self.model

        def fold(held: pd.DataFrame) -> pd.DataFrame:
            held = held.sort_values(["key", "text"])
            whole = "\n\n".join(held["text"])
            told = model("summary", prompts.render("summary", file_name=f"{held['key'].iloc[0]} to {held['key'].iloc[-1]}", contents=whole)) if model else whole
            return pd.DataFrame({"key": [held["key"].iloc[0]], "text": [told]})

        for level in itertools.count():
            path = workspace(self.spark)
            rows.write.parquet(path)
            rows = self.spark.read.schema("key string, text string").parquet(path)
            n = rows.count()
            if n <= FOLD:
                return rows
            group = F.pmod(F.xxhash64("key", "text", F.lit(level)), F.lit(-(-n // FOLD)))
            rows = rows.groupBy(group.alias("group")).applyInPandas(fold, "key string, text string")

    def suggestions(self, most: int = 4) -> list[str]:
        """Questions that the stored files suggest, by their summaries folded to one text, filled up from defaults."""
        summed = self.digest() if self.model else ""
        reply = self._ask("suggest", most=str(most), summaries=summed) if summed else ""
        return self.spark.createDataFrame([(reply,)], "r string").select(T.questions(F.col("r"), list(DEFAULTS), most).alias("q")).first()["q"]

    def export_json(self, path: str, file_name: str | None = None) -> None:
        """The stored chunks, all or a file's, as JSON lines, embeddings left out."""
        rows = self.chunks() if file_name is None else self.file_chunks(file_name)
        rows.drop("embedding").write.json(path)
