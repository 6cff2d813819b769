"""A store of epoch-versioned records: immutable, key-sorted runs and a manifest version per change.

Every change writes new runs and then one new manifest; readers take the newest manifest, so
they see a change whole or not at all, and a failed job leaves only files that no manifest
names. `vacuum` removes those after a time of grace, in which their writer may still name them. A manifest is
published by renaming, which file systems do at once (HDFS, local disks, hierarchical cloud stores); on a flat object store
only one writer may work at a time.

Level 0 holds flushed epochs, newest last. From level 1 on, a level is cut into nodes by key: a run for each, with bounds
(above `low`, up to `high`). Compaction moves records down and rewrites only nodes whose keys they meet:

* The flushed runs, once there are more than the fanout, are merged into the nodes of level 1.
* A node with more than `node_rows` records is split at its median record while its level has room (fanout ** level nodes) and nothing
  lies below; otherwise its first 2 * node_rows records, in key order, are merged into the nodes below that they meet. `consumed_upto`
  tells how far: the node's file stays, and reads pass over its records up to that key.
* A node with more than `fanout` nodes below it is split at the middle one of their bounds.

The configuration's policy says which of several such nodes are moved in a round: all, the largest, or the first and a
seeded half of the others. Records carry their epochs, so whatever the levels, the newest epoch of a key wins.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import pages_for, with_positions
from ..operators import compaction, lookup
from ..operators.membership import parquet_options
from ..schema import MANIFEST, MERGES, RECORD
from ..sources.config import StoreConfig
from .shared import file_system, remove

#: Records of a node; the page-sized nodes of the layout are far too small for files.
NODE_ROWS = 4_000_000
#: Seconds for which vacuum leaves runs that no manifest names.
GRACE = 24 * 3600


class Store:
    """`mode` tells which insert of a key's newest epoch counts: "latest" or "reference" (the first)."""

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig = StoreConfig(), mode: str = "latest", node_rows: int = NODE_ROWS, seed: int = 1):
        self.spark, self.path, self.config, self.mode, self.node_rows, self.seed = spark, path, config, mode, node_rows, seed
        self._pinned: DataFrame | None = None

    # -- manifest

    def versions(self) -> list[int]:
        fs, folder = file_system(self.spark, f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _state(self, version: int | None = None) -> dict:
        """runs, the last batch of each stream, and merges, of the newest version or of the one asked for."""
        known = self.versions()
        if not known:
            return {"runs": [], "streams": {}, "merges": []}
        fs, file = file_system(self.spark, f"{self.path}/manifest/{known[-1] if version is None else version}.json")
        stream = fs.open(file)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def runs(self, version: int | None = None) -> list[dict]:
        return self._state(version)["runs"]

    def _frame(self, rows: list[dict], schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

    def manifest(self, version: int | None = None) -> DataFrame:
        return self._frame(self.runs(version), MANIFEST)

    def merges(self) -> DataFrame:
        """What each merge moved, wrote, and how long it took."""
        return self._frame(self._state()["merges"], MERGES)

    def _publish(self, runs: list[dict], streams: dict | None = None, merge: dict | None = None) -> None:
        """Write the next version; a file that exists already means that another writer was first."""
        before = self._state()
        state = {"runs": runs, "streams": before["streams"] | (streams or {}), "merges": [*before["merges"], *([merge] if merge else [])]}
        version = (self.versions() or [0])[-1] + 1
        fs, target = file_system(self.spark, f"{self.path}/manifest/{version}.json")
        _, draft = file_system(self.spark, f"{self.path}/manifest/.{version}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"version {version} was written by another writer")

    # -- writing

    def _write(self, rows: DataFrame, level: int, nodes: list[tuple[int | None, int | None]]) -> list[dict]:
        """A run for each node (low, high) that has records; all are written by one job."""
        first = max((r["run_id"] for r in self.runs()), default=0) + 1
        path = f"{self.path}/runs/{level}-{first}-{len(self.versions())}-{time.time_ns()}"
        pivots = [high for _, high in nodes[:-1]]
        rows = rows.select(*[c.split()[0] for c in RECORD.split(", ")]).withColumn("node", compaction.route(pivots))
        options = parquet_options(self.node_rows, self.config)
        rows.repartitionByRange("node", "k").sortWithinPartitions("node", "k").write.partitionBy("node").options(**options).parquet(path)
        found = self.spark.read.schema(f"{RECORD}, node int").parquet(path).groupBy("node")
        found = found.agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n"), F.max("epoch").alias("epoch"), pages_for(F.count(F.lit(1)), self.config).alias("pages")).collect()
        if not found:
            remove(self.spark, path)
        return [
            {"run_id": first + k, "level": level, "epoch": r["epoch"], "path": f"{path}/node={r['node']}", "min_k": r["lo"], "max_k": r["hi"], "n_rows": r["n"], "n_pages": r["pages"], "consumed_upto": None,
             "low": nodes[r["node"]][0], "high": nodes[r["node"]][1]}
            for k, r in enumerate(sorted(found, key=lambda r: r["node"]))
        ]

    def ingest(self, inserts: DataFrame, epoch: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Append inserts (seq, k, v, payload) as one epoch, or with their own column `epoch`. Returns the newest epoch.

        `batch` names a stream and its batch number; one that the store has already is left out."""
        state = self._state()
        newest = max((r["epoch"] for r in state["runs"]), default=-1)
        if batch and state["streams"].get(batch[0], -1) >= batch[1]:
            return newest
        if "epoch" not in inserts.columns:
            inserts = inserts.withColumn("epoch", F.lit(newest + 1 if epoch is None else epoch).cast("long"))
        # within an epoch one row per key stays, by the store's rule; epochs stay apart for as-of reads
        best = (F.max if self.mode == "latest" else F.min)(F.struct("seq", "v", "payload"))
        flushed = inserts.groupBy("epoch", "k").agg(best.alias("x")).select("k", "x.v", "x.payload", "x.seq", "epoch")
        written = self._write(flushed, 0, [(None, None)])
        if written or batch:
            self._publish([*state["runs"], *written], {batch[0]: batch[1]} if batch else None)
        return written[0]["epoch"] if written else newest

    # -- compaction

    def _nodes(self, runs: list[dict], level: int) -> list[dict]:
        return sorted((r for r in runs if r["level"] == level), key=lambda r: r["min_k"])

    def _live(self, run: dict) -> int:
        """Records of a run that were not moved down yet."""
        return run["n_rows"] - run.get("moved", 0)

    def _merged(self, runs: list[dict], moving: DataFrame, sources: list[dict], keep: list[dict], level: int, low: int, high: int) -> None:
        """Merge moving records, whose keys lie in [low, high], into the nodes of a level that they meet. sources are replaced by keep."""
        began = time.time()
        nodes = [n for n in self._nodes(runs, level) if (n["low"] is None or n["low"] < high) and (n["high"] is None or n["high"] >= low)]
        first, last = min([low, *(n["min_k"] for n in nodes)]), max([high, *(n["max_k"] for n in nodes)])
        others = [n for n in self._nodes(runs, level) if n not in nodes]
        begin = max((n["high"] for n in others if n["high"] is not None and n["high"] < first), default=None)
        end = min((n["low"] for n in others if n["low"] is not None and n["low"] >= last), default=None)
        # the nodes and what lies between them and their neighbours, so that a level has no gaps but those of nodes that are gone
        cuts = [n["high"] for n in nodes[:-1]]
        bounds = list(zip([begin, *cuts], [*cuts, end], strict=True))
        written = self._write(self._latest(moving.unionByName(self._read(nodes))), level, bounds)
        gone = {r["run_id"] for r in [*sources, *nodes]}
        rest = [r for r in runs if r["run_id"] not in gone]
        merge = {"level": level, "rows_in": sum(map(self._live, nodes)), "nodes": len(nodes), "rows_out": sum(r["n_rows"] for r in written), "seconds": time.time() - began}
        self._publish([*rest, *keep, *written], merge=merge)

    def compact(self, level: int = 0) -> bool:
        """Merge all records of a level into the nodes of the next that they meet. False if the level is empty."""
        runs = self.runs()
        sources = [r for r in runs if r["level"] == level]
        if not sources:
            return False
        self._merged(runs, self._read(sources), sources, [], level + 1, min(r["min_k"] for r in sources), max(r["max_k"] for r in sources))
        return True

    def push_down(self, run: dict) -> None:
        """Move a node's first 2 * node_rows records, by key, into the nodes below that they meet."""
        runs = self.runs()
        take = 2 * self.node_rows
        own = self._read([run])
        if self._live(run) <= take:
            keep, moving, upto = [], own, run["max_k"]
        else:
            ranked = with_positions(own.select("k"))
            upto = ranked.where(F.col("pos") == take - 1).first()["k"]
            moving = own.where(F.col("k") <= F.lit(upto))
            keep = [run | {"consumed_upto": upto, "moved": run.get("moved", 0) + take}]
        self._merged(runs, moving, [run], keep, run["level"] + 1, run["min_k"], upto)

    def split(self, run: dict, pivot: int) -> None:
        """Two nodes in place of one: keys up to the pivot, and those above."""
        began, runs = time.time(), self.runs()
        written = self._write(self._read([run]), run["level"], [(run["low"], pivot), (pivot, run["high"])])
        merge = {"level": run["level"], "rows_in": self._live(run), "nodes": 1, "rows_out": sum(r["n_rows"] for r in written), "seconds": time.time() - began}
        self._publish([*(r for r in runs if r["run_id"] != run["run_id"]), *written], merge=merge)

    def _median(self, run: dict) -> int:
        return compaction.median_key(with_positions(self._read([run]).select("k"))).first()["split_key"]

    def _below(self, runs: list[dict], run: dict) -> list[dict]:
        return [n for n in self._nodes(runs, run["level"] + 1) if n["max_k"] >= run["min_k"] and n["min_k"] <= run["max_k"]]

    def oversized(self, level: int) -> list[dict]:
        """Nodes of a level that the configuration's policy would move now, by key."""
        found = [r for r in self._nodes(self.runs(), level) if self._live(r) > self.node_rows]
        if self.config.probablistic_merge:
            kids = self._frame([{"child": r["run_id"], "n": self._live(r), "pages": self.config.snode_size + 1} for r in found[1:]], "child long, n long, pages long")
            drawn = {r["child"] for r in compaction.sampled_oversized(kids, 0.5, self.seed + len(self.versions()), self.config).collect()}
            return [r for k, r in enumerate(found) if not k or r["run_id"] in drawn]
        return sorted(found, key=lambda r: (-self._live(r), r["min_k"]))[:1] if self.config.only_largest else found

    def maintain(self) -> int:
        """Flushed runs to level 1 where they are more than the fanout, then one round of moves and splits on each level; returns their number."""
        done = 0
        if sum(r["level"] == 0 for r in self.runs()) > self.config.fanout:
            done += self.compact(0)
        level = 1
        while level <= max((r["level"] for r in self.runs()), default=0):
            for name in [r["run_id"] for r in self.oversized(level)]:
                runs = self.runs()
                run = next((r for r in runs if r["run_id"] == name), None)
                if run is None:
                    continue
                room = len(self._nodes(runs, level)) < self.config.fanout**level and not any(r["level"] > level for r in runs)
                if room and (pivot := self._median(run)) < run["max_k"]:
                    self.split(run, pivot)
                else:
                    self.push_down(run)
                done += 1
            for name in [r["run_id"] for r in self._nodes(self.runs(), level)]:
                runs = self.runs()
                run = next((r for r in runs if r["run_id"] == name), None)
                pivots = [n["high"] for n in self._below(runs, run)[:-1]] if run else []
                middle = compaction.split_pivots(pivots, self.config.fanout)
                if middle and middle[1] is not None and run["min_k"] <= middle[1] < run["max_k"]:
                    self.split(run, middle[1])
                    done += 1
            level += 1
        return done

    def merge_pages(self) -> int:
        """Pages that the next cascade of merges reads and writes at most: two nodes' worth, twice every node of level 1, and the
        largest of what the cascades below those would take that a flush makes too large."""

        def below(level: int, nodes: list[dict]) -> int:
            if not nodes:
                return 0
            full = pages_of(self.node_rows, self.config)
            return 2 * full + sum(2 * n["n_pages"] for n in nodes) + max(below(level + 1, self._below(runs, n)) if n["n_pages"] + full > full else 0 for n in nodes)

        runs = self.runs()
        return below(1, self._nodes(runs, 1))

    def vacuum(self, grace: float = GRACE) -> list[str]:
        """Remove older manifests and runs that the newest doesn't name; runs that no manifest ever named only after
        `grace` seconds, as a writer may be about to name them. Returns the removed paths."""
        known = self.versions()
        if not known:
            return []
        folder_of = lambda r: r["path"].rsplit("/", 2)[-2]
        live = {folder_of(r) for r in self.runs()}
        named = {folder_of(r) for v in known for r in self.runs(v)}
        fs, folder = file_system(self.spark, f"{self.path}/runs")
        gone, now = [], time.time()
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            name = status.getPath().getName()
            if name not in live and (name in named or now - status.getModificationTime() / 1000 >= grace):
                gone.append(f"{self.path}/runs/{name}")
        gone += [f"{self.path}/manifest/{v}.json" for v in known[:-1]]
        for path in gone:
            remove(self.spark, path)
        return gone

    # -- reading

    def _read(self, runs: list[dict]) -> DataFrame:
        """Records of runs; those that were moved down from a node are left out, by a bound that reaches the scan."""
        whole = [r["path"] for r in runs if r["consumed_upto"] is None]
        out = self.spark.read.schema(RECORD).parquet(*whole) if whole else self.spark.createDataFrame([], RECORD)
        for r in runs:
            if r["consumed_upto"] is not None:
                out = out.unionByName(self.spark.read.schema(RECORD).parquet(r["path"]).where(F.col("k") > F.lit(r["consumed_upto"])))
        return out

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Each run holds a key once per epoch, so the newest epoch decides."""
        return rows.groupBy("k").agg(F.max_by(F.struct("v", "payload", "seq", "epoch"), "epoch").alias("x")).select("k", "x.*")

    def log(self, version: int | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
        """All stored records; only of runs whose keys meet [low, high], where that is given."""
        return self._read(self.touched(low, high, version))

    def touched(self, low: int | None = None, high: int | None = None, version: int | None = None) -> list[dict]:
        """Runs that a read of keys in [low, high] opens."""
        begins = lambda r: r["min_k"] if r["consumed_upto"] is None else max(r["min_k"], r["consumed_upto"] + 1)
        return [r for r in self.runs(version) if (high is None or begins(r) <= high) and (low is None or r["max_k"] >= low)]

    def latest(self, version: int | None = None) -> DataFrame:
        return self._latest(self.log(version))

    def get(self, key: int) -> DataFrame:
        return self._latest(lookup.point(self.log(low=key, high=key), key))

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return self._latest(lookup.multi_get(self.log(), keys))

    def range(self, low: int, high: int) -> DataFrame:
        return self._latest(self.log(low=low, high=high).where(lookup.within(low, high)))

    def as_of(self, epoch: int) -> DataFrame:
        """Newest-wins at the end of an epoch. Compaction keeps only the newest record of a key, so epochs
        before the newest compacted one are answered by versions that vacuum has not removed."""
        compacted = max((r["epoch"] for r in self.runs() if r["level"] > 0), default=-1)
        if epoch < compacted:
            for version in reversed(self.versions()):
                if max((r["epoch"] for r in self.runs(version) if r["level"] > 0), default=-1) <= epoch:
                    return self._latest(self.log(version).where(F.col("epoch") <= epoch))
            raise ValueError(f"epoch {epoch} was compacted away")
        return self._latest(self.log().where(F.col("epoch") <= epoch))

    def pin(self) -> DataFrame:
        """The newest-wins view, kept in executors' memory and disk until unpin; later versions don't change it."""
        self.unpin()
        self._pinned = self.latest().persist()
        return self._pinned

    def unpin(self) -> None:
        if self._pinned is not None:
            self._pinned.unpersist()
            self._pinned = None

    def register(self, name: str) -> None:
        """The newest-wins view for SQL."""
        self.latest().createOrReplaceTempView(name)

    def height(self) -> int:
        return len({r["level"] for r in self.runs()})


def pages_of(rows: int, config: StoreConfig) -> int:
    return -(-rows // config.page_rows)

