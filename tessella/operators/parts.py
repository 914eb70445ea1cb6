"""A table on Parquet that grows by parts and knows which of its files can hold a row.

Every row has a place, a 64-bit number by which lookups go: the hash of a file name, the list of a vector, the hash of a term. A part is
written sorted by place, in ranges, and the list of parts says of each file from which place to which it reaches. A lookup of some places
opens the files that reach over them, and within those Parquet's own statistics skip row groups. Ranges end within a place too, so a place
with a third of all rows is many files."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HIDDEN = "_place long, _part long"


class PartedTable:
    """An insert writes the new rows alone, a deletion of an owner's rows writes none: a numbered list says which parts are current and
    which owners are gone from which parts; compact() rewrites them as one part.

    Lists are made once and never changed, so a reader sees one state. Of two writers at once the second fails where the file system's
    rename does not replace (HDFS, local disks); on object stores without such a rename, let one writer at a time change a table. notes are
    what the owner of the table keeps beside it, changed together with the parts."""

    #: Deleted owners up to which a read names each in a filter, beyond it they are a table that the rows are joined with; places up to
    #: which a lookup names each to the scan; places that a lookup may ask for at all.
    MOST_NAMED, MOST_FILTERED, MOST_PLACES = 64, 1000, 10_000

    def __init__(self, spark: SparkSession, path: str, owner: str = "file_name"):
        self.spark, self.path, self.owner = spark, path.rstrip("/"), owner
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """version, parts (number and files: name, first place, last place, rows), gone (owner and the last part it is gone from), schema,
        notes."""
        lists = self._jvm_path(f"{self.path}/lists")
        found = [s.getPath().getName() for s in self._fs.listStatus(lists)] if self._fs.exists(lists) else []
        version = max((int(n.removesuffix(".json")) for n in found if n.endswith(".json")), default=-1)
        if version < 0:
            return {"version": -1, "parts": [], "gone": [], "schema": None, "notes": {}}
        stream = self._fs.open(self._jvm_path(f"{self.path}/lists/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": version}
        finally:
            stream.close()

    def publish(self, state: dict) -> dict:
        """The list is written beside the others and gets its number by a rename, which fails where the number is taken."""
        draft, final = (self._jvm_path(f"{self.path}/lists/{n}") for n in (f"_{uuid.uuid4().hex}", f"{state['version'] + 1}.json"))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({k: state[k] for k in ("parts", "gone", "schema", "notes")}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"{self.path}: another change came first; repeat this one")
        return state | {"version": state["version"] + 1}

    def files(self, state: dict, places: Iterable[int] | None = None, parts: Iterable[int] | None = None) -> list[str]:
        """The files of the current parts (or of some of them) that can hold a row of any of the places."""
        asked, some = None if places is None else sorted(set(places)), None if parts is None else set(parts)

        def reaches(low: int, high: int) -> bool:
            at = bisect_left(asked, low)
            return at < len(asked) and asked[at] <= high

        return [f"{self.path}/parts/{p}/{name}" for p, held in state["parts"] if some is None or p in some for name, low, high, _ in held if asked is None or reaches(low, high)]

    def rows(self, state: dict, places: Iterable[int] | None = None, parts: Iterable[int] | None = None) -> DataFrame | None:
        """The rows with _place and _part; with places those of the files that can hold them, and of these places where they are few."""
        if state["schema"] is None:
            return None
        schema = StructType([*StructType.fromJson(state["schema"]).fields, *StructType.fromDDL(HIDDEN).fields])
        places = None if places is None else set(places)
        whole = places is None and parts is None
        held = [f"{self.path}/parts/{p}" for p, files in state["parts"] if files] if whole else self.files(state, places, parts)
        if not held:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).parquet(*held)
        if places is not None:
            found = found.where(F.col("_place").isin(sorted(places)) if len(places) <= self.MOST_FILTERED else F.col("_place").between(min(places), max(places)))
        return self.present(state, found)

    def present(self, state: dict, rows: DataFrame) -> DataFrame:
        """rows (owner, _part) without those of deleted owners."""
        if len(state["gone"]) <= self.MOST_NAMED:
            for name, last in state["gone"]:
                rows = rows.where(~(F.col(self.owner).eqNullSafe(F.lit(name)) & (F.col("_part") <= last)))
            return rows
        gone = self.spark.createDataFrame([tuple(g) for g in state["gone"]], "_gone string, _last long")
        return rows.join(gone, F.col(self.owner).eqNullSafe(F.col("_gone")) & (F.col("_part") <= F.col("_last")), "left_anti")

    def add(self, state: dict, rows: DataFrame, keep: bool = True, notes: dict | None = None) -> dict:
        """Writes rows (with _place) as a part, beside the others or instead of them; the new state, published."""
        part = uuid.uuid4().int % 10**6 + 10**6 * (state["version"] + 1)  # ascending by version, unique among failed attempts
        plain = rows.drop("_part", "_place")
        spread = F.xxhash64(*[F.col(f"`{c}`") for c, kind in plain.dtypes if "map" not in kind])
        laid = rows.drop("_part").withColumns({"_part": F.lit(part).cast("long"), "_spread": spread}).repartitionByRange("_place", "_spread").sortWithinPartitions("_place").drop("_spread")
        where = f"{self.path}/parts/{part}"
        laid.write.parquet(where)
        reach = self.spark.read.schema("_place long").parquet(where).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min("_place").alias("low"), F.max("_place").alias("high"), F.count("*").alias("n"))
        held = sorted([r["name"], r["low"], r["high"], r["n"]] for r in reach.collect())  # a row a file
        fields = {f["name"]: f for f in (state["schema"] or {"fields": []})["fields"]}
        fields |= {f["name"]: f for f in plain.schema.jsonValue()["fields"] if f["name"] not in fields}
        schema = {"type": "struct", "fields": [f | {"nullable": True} for f in fields.values()]}
        return self.publish(state | {"parts": [*(state["parts"] if keep else []), [part, held]], "gone": state["gone"] if keep else [], "schema": schema, "notes": state["notes"] | (notes or {})})

    def forget(self, state: dict, name: str | None, notes: dict | None = None) -> dict:
        """Deletes an owner's rows from all present parts."""
        last = max((p for p, _ in state["parts"]), default=-1)
        return self.publish(state | {"gone": [*(g for g in state["gone"] if g[0] != name), [name, last]], "notes": state["notes"] | (notes or {})})

    def clear(self) -> None:
        state = self.state()
        if state["schema"] is not None:
            self.publish(state | {"parts": [], "gone": [], "notes": {}})

    def drop(self) -> None:
        self._fs.delete(self._jvm_path(self.path), True)

    def compact(self) -> None:
        """The current rows as one part, without traces of deleted owners; older parts stay for readers until vacuum()."""
        state = self.state()
        if state["parts"]:
            self.add(state, self.rows(state), False)

    def vacuum(self) -> None:
        """Deletes the parts that the current list does not name."""
        parts, current = self._jvm_path(f"{self.path}/parts"), {str(p) for p, _ in self.state()["parts"]}
        for s in self._fs.listStatus(parts) if self._fs.exists(parts) else []:
            if s.getPath().getName() not in current:
                self._fs.delete(s.getPath(), True)
