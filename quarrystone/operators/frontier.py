"""Growth of a corpus along citations: rounds over a frontier, each with gates, quota and cap.

A round takes what the frontier's papers refer to and what cites them.  Links without a title or
off the subject go.  Of the rest, papers that aren't in the corpus are taken in order of their first
link (source, references before citations, place): references always, citations by the soft quota
of their layer, and none once the corpus holds as many papers as it may.  Papers that are there
already are updated, and neither they nor what changes in them counts for the quota of that round.
Edges are kept for all links whose both ends are in the corpus then.  What was taken is the next
frontier.

Each round is written under ``root`` and found there again, so a run that was lost goes on with the
round that it was in.  Null ids and sources link nothing; repeated links are one; ties of a place
go by id; without seeds or links nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone import config
from quarrystone.functions.text import is_relevant, layer_of
from quarrystone.operators import reports, tables
from quarrystone.sources.shared import is_there, stored

PAPERS = ("paper_id", "title", "abstract", "layer", "is_seed")
EDGES = ("source", "target", "direction")
LAYERS = ("prerequisite", "foundation", "core", "latest")


def gated(links: DataFrame) -> DataFrame:
    """Links with what decides on them: ``gate`` is no_title, not_relevant or open.  ``link`` names a
    row once the frame is stored; what isn't open has no abstract any more."""
    title = F.trim(F.coalesce("title", F.lit("")))
    gate = F.when(title == "", "no_title").when(~is_relevant(F.col("title"), F.coalesce("abstract", F.lit(""))), "not_relevant").otherwise("open")
    d = links.where("source is not null and paper_id is not null and paper_id <> ''").withColumn("gate", gate)
    return d.withColumns({"abstract": F.when(F.col("gate") == "open", F.col("abstract")), "link": F.monotonically_increasing_id()})


def one_round(papers: DataFrame, edges: DataFrame, frontier: DataFrame, links: DataFrame, *, cap: int, shares: dict[str, float] = config.LAYER_SHARES, block: int = reports.QUOTA_BLOCK) -> dict[str, DataFrame]:
    """papers, edges and frontier after a round, and counts: how many links each gate, the quota
    and the cap kept out, and how many papers were taken.

    ``links`` may be gated and stored before.  Abstracts stay out of all decisions: they are read
    for what is taken or updated alone."""
    links = links if "gate" in links.columns else stored(gated(links), "links")
    d = links.withColumn("of_abstract", F.xxhash64("abstract")) if "of_abstract" not in links.columns else links
    d = d.drop("abstract").join(frontier.select(F.col("paper_id").alias("source")).distinct(), "source", "left_semi")
    d = stored(d, "round")
    free = F.col("direction") == "reference"
    order = F.struct("source", (~free).alias("late"), "place", "paper_id")
    fields = ["title", "of_abstract", "link", layer_of(F.col("year"), free).alias("layer"), free.alias("free")]
    first = d.where("gate = 'open'").select("paper_id", order.alias("at"), F.struct(*fields).alias("x")).groupBy("paper_id").agg(F.min(F.struct("at", "x")).alias("m")).select("paper_id", "m.at", "m.x.*")
    first = stored(first, "first")
    new = first.join(papers.select("paper_id"), "paper_id", "left_anti")
    held = {r["layer"]: r["n"] for r in papers.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()}
    let_in = stored(reports.quota(new.select("at", "layer", "free"), shares, key="at", held=held, free="free", block=block), "let_in")
    taken = new.join(let_in.where(F.col("total") <= cap).select(F.col("at.paper_id").alias("paper_id")), "paper_id", "left_semi")
    seen = first.join(papers.select("paper_id"), "paper_id", "left_semi")
    rows = stored(taken.unionByName(seen).select("paper_id", "title", "link", "layer"), "taken")
    abstracts = links.where("gate = 'open'").select("link", "abstract")
    whole = rows.join(abstracts, "link").select("paper_id", "title", "abstract", "layer", F.lit(False).alias("is_seed"))
    merged = tables.upsert(papers.select(*PAPERS), whole, "paper_id", tables.PAPER_RULES)
    linked = d.where("gate = 'open'").join(rows.select("paper_id"), "paper_id", "left_semi").select("source", F.col("paper_id").alias("target"), "direction")
    counts = d.groupBy("gate").agg(F.count(F.lit(1)).alias("n"))
    more = let_in.agg(F.count(F.lit(1)).alias("passed"), F.count_if(F.col("total") > cap).alias("cap")).crossJoin(new.agg(F.count(F.lit(1)).alias("new")))
    more = more.select(F.explode(F.array(*[F.struct(F.lit(name).alias("gate"), n.alias("n")) for name, n in (("quota", F.col("new") - F.col("passed")), ("cap", F.col("cap")), ("taken", F.col("passed") - F.col("cap")))])).alias("x")).select("x.*")
    return {"papers": merged, "edges": tables.insert_ignore(edges.select(*EDGES), linked, list(EDGES)), "frontier": taken.select("paper_id"), "counts": counts.unionByName(more)}


def expand(papers: DataFrame, edges: DataFrame, links: DataFrame, root: str, *, rounds: int = 2, cap: int = 50_000, **options) -> dict[str, DataFrame]:
    """papers, edges, frontier after all rounds, and counts (round, gate, n).

    papers (paper_id, title, abstract, layer, is_seed); edges (source, target, direction); links
    (source, paper_id, direction, title, abstract, year, place), direction reference or citation."""
    spark = papers.sparkSession
    now = {"papers": papers.select(*PAPERS), "edges": edges.select(*EDGES), "frontier": papers.where("is_seed").select("paper_id")}
    links = stored(gated(links).withColumn("of_abstract", F.xxhash64("abstract")), "links")
    counts = spark.createDataFrame([], "round int, gate string, n long")
    for k in range(rounds):
        at = f"{root}/round={k}"
        if not is_there(spark, f"{at}/counts/_SUCCESS"):
            made = one_round(now["papers"], now["edges"], now["frontier"], links, cap=cap, **options)
            for name in ("frontier", "papers", "edges", "counts"):  # counts last: they say that the round is whole
                made[name].write.mode("overwrite").parquet(f"{at}/{name}")
        now = {name: spark.read.parquet(f"{at}/{name}") for name in ("papers", "edges", "frontier", "counts")}
        counts = counts.unionByName(now.pop("counts").select(F.lit(k).alias("round"), "gate", "n"))
    return now | {"counts": counts}
