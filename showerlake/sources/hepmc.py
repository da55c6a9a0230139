"""Event records as text: one line per event, vertex and particle, keyed by its first letter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import running_sums


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line). Compressed files are read by their ending. Line numbers grow within a file."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return rows


def from_lines(lines: DataFrame, start: int | None = None, stop: int | None = None) -> dict[str, DataFrame]:
    """Tables events, headers, vertices and particles of lines (file, line_no, line).

    A line belongs to the last event line before it in its file; a particle starts at the last vertex
    before it. Missing numbers are null. Events are numbered by running sums over ranges of lines, and what
    follows is a window per event, so one large file is read by many tasks.
    """
    marked = lines.select("file", "line_no", "line", F.when(F.trim("line").rlike(r"^E(\s|$)"), 1).otherwise(0).alias("is_event"))
    lines = running_sums(marked, ["file"], ["line_no"], {"event_no": "is_event"}).where("event_no > 0")
    w = Window.partitionBy("file", "event_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    f = F.split(F.trim("line"), r"\s+")
    field = lambda i, kind: F.get("f", F.lit(i)).try_cast(kind)
    tagged = lines.withColumn("f", f).withColumn("kind", F.get("f", F.lit(0)))
    tagged = tagged.withColumn("event_id", F.last(F.when(F.col("kind") == "E", field(1, "long")), ignorenulls=True).over(w))
    tagged = tagged.withColumn("vertex", F.last(F.when(F.col("kind") == "V", field(1, "int")).when(F.col("kind") == "E", F.lit(-(2**31))), ignorenulls=True).over(w))
    tagged = tagged.where("event_id is not null")
    if start is not None:
        tagged = tagged.where(F.col("event_id") >= start)
    if stop is not None:
        tagged = tagged.where(F.col("event_id") < stop)
    n_random = F.coalesce(field(11, "int"), F.lit(0))
    events = tagged.where("kind = 'E'").select(
        "event_id", field(2, "int").alias("n_interactions"), field(3, "double").alias("scale"), field(4, "double").alias("alpha_qcd"), field(5, "double").alias("alpha_qed"), field(6, "int").alias("process"), field(8, "int").alias("n_vertices"),
        F.transform(F.slice("f", 13, n_random), lambda x: x.try_cast("long")).alias("random_states"), F.transform(F.slice("f", F.lit(14) + n_random, F.coalesce(F.get("f", F.lit(12) + n_random).try_cast("int"), F.lit(0))), lambda x: x.try_cast("double")).alias("weights"),
    )
    headers = tagged.where("kind in ('N', 'U', 'C', 'H', 'F')").select("event_id", "kind", F.slice("f", 2, F.size("f")).alias("values"))
    vertices = tagged.where("kind = 'V'").select("event_id", field(1, "int").alias("barcode"), field(3, "double").alias("x"), field(4, "double").alias("y"), field(5, "double").alias("z"), field(6, "double").alias("ctau"))
    order = Window.partitionBy("event_id").orderBy("line_no")
    found = tagged.where("kind = 'P'").select(
        "event_id", (F.row_number().over(order) - 1).alias("idx"), field(1, "int").alias("barcode"), field(2, "int").alias("mcpid"), field(3, "double").alias("px"), field(4, "double").alias("py"), field(5, "double").alias("pz"),
        field(6, "double").alias("energy"), field(7, "double").alias("generated_mass"), field(8, "int").alias("status"), F.when(F.col("vertex") > -(2**31), F.col("vertex")).alias("start_vertex"), field(11, "int").alias("end_vertex"),
    )
    return {"events": events, "headers": headers, "vertices": vertices, "particles": found}


def decode_headers(headers: DataFrame) -> DataFrame:
    """(event_id, weight_names, momentum_unit, length_unit, cross_section, cross_section_error) from header rows, one per event.

    N lines hold a count and quoted names, U lines two units, C lines a value and its error; what is not there is null.
    """
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    at = lambda i: F.get("values", F.lit(i))
    names = F.transform(F.slice("values", 2, F.greatest(F.size("values"), F.lit(1))), lambda x: F.regexp_replace(x, "^\"|\"$", ""))
    return headers.groupBy("event_id").agg(
        of("N", names).alias("weight_names"), of("U", at(0)).alias("momentum_unit"), of("U", at(1)).alias("length_unit"),
        of("C", at(0).try_cast("double")).alias("cross_section"), of("C", at(1).try_cast("double")).alias("cross_section_error"),
    )


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(n_events, n_particles, n_vertices) of a parsed record."""
    rows = [tables[name].select(*(F.lit(int(name == other)).alias(f"n_{other}") for other in ("events", "particles", "vertices"))) for name in ("events", "particles", "vertices")]
    return rows[0].union(rows[1]).union(rows[2]).agg(*(F.coalesce(F.sum(f"n_{name}"), F.lit(0)).alias(f"n_{name}") for name in ("events", "particles", "vertices")))


def to_lines(particles: DataFrame) -> DataFrame:
    """(file, line_no, line) from (event_id, idx, mcpid, px, py, pz, energy, start_vertex): event, vertex, particles.

    Lines carry a sortable number instead of being collected; a writer sorts each file by it.
    """
    text = lambda c: F.col(c).cast("string")
    p = particles.select(
        "event_id", "start_vertex", (F.lit(2) + F.col("idx")).alias("n"),
        F.concat_ws(" ", F.lit("P"), F.col("idx") + 1, "mcpid", text("px"), text("py"), text("pz"), text("energy"), F.lit("0 1 0 0 0 0")).alias("line"),
    )
    vertices = particles.groupBy("event_id", "start_vertex").agg(F.count("*").alias("out"))
    v = vertices.select("event_id", "start_vertex", F.lit(1).alias("n"), F.concat_ws(" ", F.lit("V"), "start_vertex", F.lit("0 0 0 0 0 0"), "out", F.lit("0")).alias("line"))
    e = vertices.groupBy("event_id").agg(F.count("*").alias("nv")).select("event_id", F.lit(None).cast("int").alias("start_vertex"), F.lit(0).alias("n"), F.concat_ws(" ", F.lit("E"), "event_id", F.lit("-1 0 0 0 0 -1"), "nv", F.lit("1 2 0 0")).alias("line"))
    rows = e.unionByName(v).unionByName(p)
    # within an event: the event line, then vertex by vertex with its particles behind it
    number = F.struct(F.col("event_id"), F.coalesce("start_vertex", F.lit(-(2**31))).alias("v"), F.col("n"))
    return rows.select(F.pmod("event_id", F.lit(16)).cast("string").alias("file"), number.alias("line_no"), "line")


def write_lines(lines: DataFrame, path: str) -> None:
    """One sorted text file per value of `file`."""
    lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "line").write.partitionBy("file").text(path)
