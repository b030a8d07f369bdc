"""The whole window behind one object, over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyhold import operators as ops
from keyhold.config import WindowConfig
from keyhold.functions import sightings
from keyhold.sources.state import COUNTS, HELD, Saved, load_state, save_state, settled


class KeyWindow:
    """A window over a table of sightings; ``held`` is a DataFrame (key, anchor, tie).

    ``clock`` is the latest time that the window knows of, from sightings or ``advance``. A sighting before it comes late:
    it is handed back as such, and changes nothing. So at any time admitted = retained + expired + evicted.

    ``observe`` settles the marks and what is held, so plans don't grow with the number of calls; counts are summed up then.
    """

    def __init__(self, config: WindowConfig, held: DataFrame | None = None) -> None:
        self.config = config
        self.held = SparkSession.active().range(0).selectExpr(*HELD) if held is None else held
        self.clock: int | None = None
        self.counts = dict.fromkeys(COUNTS, 0)  # since the window began
        self.versions: dict[str, int] = {}  # of the directories that it was read from or saved to

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: WindowConfig | None = None) -> KeyWindow:
        """The saved window, or an empty one if nothing is saved there yet; that needs a config.

        A new config replaces the saved one and holds from the next observe or advance on.
        """
        out = cls(config or WindowConfig())
        if not out._take(load_state(spark, path), path) and config is None:
            raise ValueError(f"no saved window in {path}, and no config for a new one")
        out.config = config or out.config
        return out

    def _take(self, saved: Saved, path: str) -> bool:
        self.versions[path] = saved.version
        if saved.version:
            self.held, self.config, self.clock, self.counts = saved.held, saved.config, saved.clock, dict(saved.counts)
        return saved.version > 0

    def observe(self, df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
        """The table's sightings with ``admitted`` and ``late``; ``admitted`` is null for those that come late.

        What is held before counts as sighted at its anchor, before any new sighting of that time.
        """
        new = sightings(df, key, time, tie)
        place = lambda n: F.struct(F.lit(n).alias("call"), F.col("tie").cast(new.schema["tie"].dataType).alias("tie")).alias("tie")
        late = F.lit(False) if self.clock is None else F.col("t") < F.lit(self.clock)
        rows = new.select("key", "t", place(1), late.alias("late"))
        old = self.held.select("key", F.col("anchor").alias("t"), place(0))
        both = old.withColumn("_held", F.lit(True)).unionByName(rows.filter("NOT late").drop("late").withColumn("_held", F.lit(False)))
        marked = ops.marked_for_stats(both, self.config).withColumn("late", F.lit(False))
        marked = settled(marked.unionByName(rows.filter("late").withColumn("_held", F.lit(False)), allowMissingColumns=True))
        taken = marked.filter("NOT late")
        end, came_late = marked.agg(F.max(F.when(~F.col("late"), F.col("t"))), F.count_if("late")).first()
        self.clock = max((x for x in (self.clock, end) if x is not None), default=None)
        found = ops.tallied(taken, self.config, ~F.col("_held"), self.clock).first().asDict() | {"late": came_late}
        self.counts = {c: self.counts[c] + found[c] for c in COUNTS}
        held = ops.held_after(taken, self.config, self.clock)
        self.held = settled(held.withColumn("tie", F.col("tie.tie")))
        return marked.filter("NOT _held").select("key", "t", F.col("tie.tie").alias("tie"), "admitted", "late")

    def seen(self, probe: DataFrame, key: str, now: int | None = None, sketch: ops.KeySketch | None = None) -> DataFrame:
        """The probe's rows with ``seen``: whether the key is held and not too old at ``now``; None: at the window's clock.

        sketch: from ``sketch``, made since the last observe or merged with what that added; it prunes the probe before the join.
        """
        now = self.clock if now is None else now
        held = ops.fresh(self.held, self.config, now)
        if sketch is None:
            return ops.flag_seen(probe, held, key)
        return ops.flag_seen_pruned(probe, held, sketch if now is None else sketch.fresh(now, self.config.span_us), key)

    def sketch(self, bucket_us: int) -> ops.KeySketch:
        """A sketch of what is held, with room for as many keys."""
        return ops.KeySketch.of(self.held, self.held.count(), bucket_us)

    def advance(self, now: int) -> DataFrame:
        """Drop what is too old at ``now``; a row with ``dropped``. Sightings before ``now`` come late from here on."""
        held, dropped = ops.advance(self.held, self.config, now)
        dropped = settled(dropped)
        self.held = settled(held)
        self.clock = now if self.clock is None else max(now, self.clock)
        self.counts["expired"] += dropped.first().dropped
        return dropped

    def keys(self) -> DataFrame:
        return ops.retained_keys(self.held)

    def stats(self, spark: SparkSession) -> DataFrame:
        """One row: span, capacity, retained, and since the window began admitted, expired, evicted and repeats."""
        row = {"retained": self.held.count(), **self.counts}
        return ops.described(spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} long" for c in row)), self.config)

    def save(self, path: str) -> int:
        """The new version's number; StaleWindowError if the directory has a version that this window doesn't follow."""
        version = save_state(Saved(self.versions.get(path, 0), self.held, self.config, self.clock, self.counts), path)
        self.versions[path] = version
        return version

    def load(self, spark: SparkSession, path: str) -> None:
        """Read and check the saved window, then replace this one."""
        saved = load_state(spark, path)
        if not saved.version:
            raise ValueError(f"no saved window in {path}")
        self._take(saved, path)
