"""Change detection between two snapshots of watched sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

FLAG_KINDS = [
    "index-page-unreachable",
    "new-edition",
    "count-moved",
    "count-unknown",
    "page-unreachable",
    "page-changed",
]


def page_states(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(url, state, hash): the hash to keep and how it came about.

    ``current`` holds (url, body), or (url, hash) with the body's hash, null for an unreachable page; ``previous`` holds
    (url, hash). First sight is a baseline, an unreachable page
    keeps its old hash, a page no longer watched is dropped.
    """
    now = F.col("hash") if "hash" in current.columns else F.sha2("body", 256)
    seen = current.select("url", now.alias("_now"), F.lit(True).alias("_watched"))
    joined = seen.join(previous.select("url", F.col("hash").alias("_old")), "url", "full_outer")
    state = (
        F.when(F.col("_watched").isNull(), "dropped")
        .when(F.col("_now").isNull(), "unreachable")
        .when(F.col("_old").isNull(), "new")
        .when(F.col("_old") != F.col("_now"), "changed")
        .otherwise("same")
    )
    return joined.select("url", state.alias("state"), F.coalesce("_now", "_old").alias("hash"))


def new_links(pages: DataFrame, html: str, known: DataFrame, seen: DataFrame, extension: str | None = "pdf") -> DataFrame:
    """Distinct links on the pages that are neither known nor seen before."""
    return unseen_links(pages.select(F.explode(text.page_links(F.col(html), extension)).alias("link")), known, seen)


def unseen_links(found: DataFrame, known: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct links of ``found`` (link) that are neither known nor seen before."""
    return found.distinct().join(known.select("link").union(seen.select("link")).distinct(), "link", "left_anti")


def _flag(df: DataFrame, kind: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), detail.alias("detail"))


def page_flags(states: DataFrame, titles: DataFrame) -> DataFrame:
    """Flags of watched pages with their titles; a baseline or unchanged page raises none."""
    named = states.filter(F.col("state").isin("changed", "unreachable")).join(titles.select("url", "title"), "url", "left")
    changed = F.concat("title", F.lit(" page changed since the last check ("), "url", F.lit(")"))
    lost = F.concat("title", F.lit(" ("), "url", F.lit(") could not be fetched"))
    is_changed = F.col("state") == "changed"
    return named.select(
        F.when(is_changed, "page-changed").otherwise("page-unreachable").alias("kind"),
        F.col("url").alias("key"),
        F.when(is_changed, changed).otherwise(lost).alias("detail"),
    )


def count_flags(leads: DataFrame, key: str, lead: str, expected: Column) -> DataFrame:
    """A count above the expected one, or one that cannot be read; a lower count raises nothing."""
    n = text.phrase_number(F.col(lead))
    counted = leads.withColumns({"_n": n, "_e": expected})
    moved = F.concat(
        F.lit("lead now says "), F.col("_n").cast("string"), F.lit(" amendments; expected "), F.col("_e").cast("string")
    )
    higher = _flag(counted.filter(F.col("_n") > F.col("_e")), "count-moved", F.col(key), moved)
    unknown = _flag(
        counted.filter(F.col("_n").isNull()), "count-unknown", F.col(key), F.lit("could not read the count; review manually")
    )
    return higher.unionByName(unknown)


def index_flags(index: DataFrame, known: DataFrame, seen: DataFrame, extension: str | None = "pdf") -> DataFrame:
    """Unreachable index pages, and links on reachable ones that are new.

    ``index`` holds (url, html), or (url, links) with the links read from the page; null for an unreachable one.
    """
    links = F.col("links") if "links" in index.columns else text.page_links(F.col("html"), extension)
    page = "links" if "links" in index.columns else "html"
    lost = _flag(
        index.filter(F.col(page).isNull()), "index-page-unreachable", F.col("url"), F.lit("index page could not be fetched; review manually")
    )
    fresh = unseen_links(index.filter(F.col(page).isNotNull()).select(F.explode(links).alias("link")), known, seen)
    return lost.unionByName(_flag(fresh, "new-edition", F.col("link"), F.col("link")))


def next_links(index: DataFrame, seen: DataFrame, extension: str | None = "pdf") -> DataFrame:
    """Links to carry into the next run; those seen before survive an unreachable page."""
    found = index.select(F.explode(text.page_links(F.col("html"), extension)).alias("link"))
    return found.union(seen.select("link")).distinct()


#: What a report says beside its flags.
REPORT_NOTE = "The detector only observes its sources. A person confirms what is listed and sets the dates."
REPORT_SOUND = "No changes detected. Sources look the same as the last check."
REPORT_ASKS = "Open the sources, confirm each change, then update the verified dates."
REPORT_FIRST = "First run: baseline recorded, nothing to compare against yet."
#: Sections of a report: flags of kind k stand in FIRST_FLAG + k, and what follows them behind.
FIRST_FLAG, CLOSING = 10, 99


def report_lines(flags: DataFrame, checked: str, first_run: bool = False) -> DataFrame:
    """(section, line) of a Markdown report, every line of it: headings, date, note, one line per flag, blanks, closing.

    Rows, not one string: the report grows with the flags and is written in order of (section, line). The flags are read
    twice, so they are checkpointed, not detected again; no flag leaves the cluster.
    """
    from ..session import checkpointed

    flags = checkpointed(flags)
    spark = flags.sparkSession
    head = ["# Source check report", "", f"Checked: {checked}", "", REPORT_NOTE, ""]
    head += [REPORT_FIRST, ""] if first_run else []
    given = spark.createDataFrame(list(enumerate(head)), "section int, line string")
    kind = F.array_position(F.array(*[F.lit(k) for k in FLAG_KINDS]), F.col("kind"))
    bullets = flags.select(
        (kind + FIRST_FLAG).cast("int").alias("section"), F.concat(F.lit("- **"), "kind", F.lit("**: "), "detail").alias("line")
    )

    def lines(entries: list[tuple[int, str]]) -> Column:
        return F.array(*[F.struct(F.lit(s).alias("section"), F.lit(t).alias("line")) for s, t in entries])

    found = lines([(FIRST_FLAG - 2, "## Changes detected"), (FIRST_FLAG - 1, ""), (CLOSING - 1, ""), (CLOSING, REPORT_ASKS)])
    # one counted row decides what stands around the flags
    some = flags.agg((F.count(F.lit(1)) > 0).alias("some"))
    around = some.select(F.inline(F.when(F.col("some"), found).otherwise(lines([(CLOSING, REPORT_SOUND)]))))
    return given.unionByName(bullets).unionByName(around)


def staleness(rows: DataFrame, source: str, moment: str, as_of: Column) -> DataFrame:
    """Days between a date and the latest one of each source."""
    latest = rows.groupBy(source).agg(F.to_date(F.max(moment)).alias("_latest"))
    return latest.select(source, F.col("_latest").cast("string").alias("latest"), F.datediff(as_of, F.col("_latest")).alias("days"))
