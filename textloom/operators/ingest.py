"""Incremental ingest of articles and files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions import text as T
from textloom.shared import materialize, maybe_broadcast

#: Ids of one file name that are numbered in one task.
NAME_PART = 100_000


def once(articles: DataFrame, id_col: str = "ordinal") -> DataFrame:
    """Articles delivered more than once, once each. Where rows of an id differ, the one with the smallest hash of its columns counts.

    Repeats are few: ids that come twice are found on ids alone (counts combine before the shuffle), and only their rows
    are shuffled; the others go through as they are. A null id is an id.
    """
    twice = maybe_broadcast(materialize(articles.groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("__id")), "repeats"), 24)
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    whole = F.xxhash64(*articles.columns)
    first = Window.partitionBy(id_col).orderBy(whole)
    again = articles.join(twice, same, "left_semi").withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")
    return articles.join(twice, same, "left_anti").unionByName(again)


def keyword_filter(articles: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """any keyword, in any case, in title, digest or a body column; without keywords all pass; null columns are empty."""
    words = [k.lower() for k in keywords if k.strip()]
    if not keywords:
        return articles
    if not words:
        return articles.where(F.lit(False))
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "digest", "content", "content_text", "content_markdown")]))
    hit = F.lit(False)
    for w in words:
        hit = hit | hay.contains(w)
    return articles.where(hit)


def article_time() -> Column:
    """Epoch seconds of an article: update time, else creation time; 0 counts as absent."""
    return F.coalesce(F.nullif(F.col("update_time").cast("long"), F.lit(0)), F.nullif(F.col("create_time").cast("long"), F.lit(0)))


def until_filter(articles: DataFrame, until: str) -> DataFrame:
    """articles with a time up to the end of a day (UTC); those without a time go."""
    return articles.where((article_time() > 0) & (article_time() <= F.unix_timestamp(F.lit(until), "yyyy-MM-dd") + 86_399))


def since_take_while(articles: DataFrame, since: str, by: str = "account", order: str = "ordinal", newest_first: bool = False) -> DataFrame:
    """per account, in arrival order, the articles before the first one older than a day; no time counts as 0, older.

    The first older place is one aggregated row an account, joined back: no window over an account's articles.
    """
    old = F.coalesce(F.col("update_time").cast("long"), F.lit(0)) < F.unix_timestamp(F.lit(since), "yyyy-MM-dd")
    first = F.max(F.when(old, F.col(order))) if newest_first else F.min(F.when(old, F.col(order)))
    stop = articles.groupBy(by).agg(first.alias("__stop"))
    x = articles.join(stop, articles[by].eqNullSafe(stop[by])).drop(stop[by])
    keep = F.col("__stop").isNull() | (F.col(order) > F.col("__stop") if newest_first else F.col(order) < F.col("__stop"))
    return x.where(keep).drop("__stop")


def cap(articles: DataFrame, most: int, by: str = "account", order: str = "ordinal") -> DataFrame:
    """the first most articles of an account (the feature's own cap)."""
    w = Window.partitionBy(by).orderBy(order)
    return articles.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def quality(files: DataFrame, text: str = "text") -> DataFrame:
    """files with passed: a body of at least 100 characters that is no verification page."""
    return files.withColumn("passed", T.passes_quality(text))


def article_link() -> Column:
    """The first non-empty of link, url and source; empty if there is none."""
    return F.coalesce(T.blank_to_null(F.col("link")), T.blank_to_null(F.col("url")), T.blank_to_null(F.col("source")), F.lit(""))


def history_links(files: DataFrame, text: str = "text") -> DataFrame:
    """Distinct source links of stored files."""
    return files.select(T.source_of(text).alias("link")).where("link <> ''").distinct()


def split_new(articles: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles whose link isn't in the history, those whose link is); a blank link is never in it."""
    x = articles.withColumn("__link", article_link())
    h = links.select(F.col("link").alias("__link"))
    return x.join(h, "__link", "left_anti").drop("__link"), x.join(h, "__link", "left_semi").drop("__link")


def history_files(files: DataFrame) -> DataFrame:
    """(norm, path, md5) of the latest file of each normal name; ties to the larger path."""
    x = files.withColumn("norm", T.normal_name("name"))
    return x.groupBy("norm").agg(F.max(F.struct("mtime", "path", "md5")).alias("m")).select("norm", "m.path", "m.md5")


def sync_plan(incoming: DataFrame, history: DataFrame) -> DataFrame:
    """Incoming (ord, name, md5) with action: sync, duplicate or bad_name, and the month to store under.

    Files of a normal name go in order; one is compared with the last accepted one before it, else with the history. A
    canonical file is accepted unless its content equals the last accepted content, so among canonical files of a name
    acceptance is a change from the file before; other names never change what was accepted.
    """
    x = incoming.withColumn("norm", T.normal_name("name")).withColumn("canonical", F.regexp_like("name", F.lit(K.CANONICAL_NAME)))
    x = x.join(history.select("norm", F.col("md5").alias("hist")), "norm", "left")
    w = Window.partitionBy("norm").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last(F.when(F.col("canonical"), F.col("md5")), ignorenulls=True).over(w), F.col("hist"))
    x = x.withColumn("same", F.coalesce(F.col("md5") == before, F.lit(False)))
    action = F.when(F.col("same"), F.lit("duplicate")).when(~F.col("canonical"), F.lit("bad_name")).otherwise(F.lit("sync"))
    return x.select("ord", "name", "norm", "md5", action.alias("action"), T.month_of_file("name").alias("month"))


def since_dates(accounts: DataFrame, state: DataFrame, as_of: str, fallback_days: int = 14) -> DataFrame:
    """(account, since): a day before the last success; fallback_days before as_of without one."""
    x = accounts.join(state.select("account", "last_success_timestamp"), "account", "left")
    since = F.coalesce(F.date_sub(F.to_date("last_success_timestamp"), 1), F.date_sub(F.to_date(F.lit(as_of)), fallback_days))
    return x.select("account", F.date_format(since, "yyyy-MM-dd").alias("since"))


def resolve_since(since: str | None, no_checkpoint: bool, from_state: str | None) -> str | None:
    """An explicit date, else the beginning of time without checkpoints, else the state's."""
    return since or ("1970-01-01" if no_checkpoint else from_state)


def update_state(state: DataFrame, runs: DataFrame) -> DataFrame:
    """State after runs (account, ok, at timestamp, batch_dir, new_articles, reason): counters add up, the last run's fields win."""
    ok, bad = F.col("ok"), ~F.col("ok")
    d = runs.groupBy("account").agg(
        F.sum(ok.cast("int")).cast("int").alias("s"), F.sum(bad.cast("int")).cast("int").alias("f"), F.sum(F.when(ok, F.col("new_articles")).otherwise(0)).alias("n"),
        F.max(F.when(ok, F.struct("at", "batch_dir"))).alias("good"), F.max(F.when(bad, F.struct("at", "reason"))).alias("bad"),
    )
    x = state.join(d, "account", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return x.select(
        "account", F.coalesce(stamp("good.at"), "last_success_time").alias("last_success_time"), F.coalesce("good.at", "last_success_timestamp").alias("last_success_timestamp"),
        F.coalesce("good.batch_dir", "last_batch_dir").alias("last_batch_dir"), (zero(F.col("total_articles_ever")) + zero(F.col("n"))).cast("long").alias("total_articles_ever"),
        (zero(F.col("success_count")) + zero(F.col("s"))).cast("int").alias("success_count"), (zero(F.col("failure_count")) + zero(F.col("f"))).cast("int").alias("failure_count"),
        F.coalesce(stamp("bad.at"), "last_failure_time").alias("last_failure_time"), F.coalesce("bad.reason", "last_failure_reason").alias("last_failure_reason"),
    )


def batch_plan(articles: DataFrame, per_batch: int = 100, by: str = "account") -> DataFrame:
    """(account, articles, batches)."""
    return articles.groupBy(by).agg(F.count("*").alias("articles")).withColumn("batches", F.ceil(F.col("articles") / per_batch).cast("long"))


def resumable(progress: DataFrame, since: str | None, most: int | None) -> DataFrame:
    """Progress rows of the same since date and cap."""
    return progress.where(F.col("since_date").eqNullSafe(F.lit(since)) & F.col("max_articles").eqNullSafe(F.lit(most)))


def crawl_totals(articles: DataFrame) -> DataFrame:
    """One row (total, success, failed, rate): an article succeeded if a body column isn't a verification page."""
    ok = ~T.is_verify_page(F.coalesce(T.blank_to_null(F.col("content_text")), F.col("content")))
    x = articles.agg(F.count("*").alias("total"), F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias("success"))
    return x.withColumn("failed", F.col("total") - F.col("success")).withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("success") * 100.0 / F.col("total"), 1)))


def markdown_export(articles: DataFrame) -> DataFrame:
    """(ordinal, folder, file_name, markdown) of every article with a body; equal names in a folder get a number by ordinal.

    An article without a creation time goes under 1970-01; results do not depend on the clock.
    """
    x = articles.withColumn("content", F.coalesce(*[T.blank_to_null(F.col(c)) for c in ("content_markdown", "content_text", "content")])).where(F.col("content").isNotNull())
    at = F.timestamp_seconds(F.coalesce(F.col("create_time").cast("long"), F.lit(0)))
    title = F.coalesce("title", F.lit("无标题"))
    x = x.select("ordinal", F.concat(T.file_name(F.coalesce("account", F.lit(""))), F.lit("/"), F.date_format(at, "yyyy-MM")).alias("folder"), F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("_"), T.file_name(title)).alias("stem"), title.alias("title"), at.alias("at"), F.coalesce("link", F.lit("")).alias("link"), F.coalesce("account", F.lit("")).alias("account"), "content")
    # names alone are numbered, in parts of their hash where one name is very common: counts of the parts, then places in them
    names = x.select("ordinal", "folder", "stem")
    names = materialize(names.join(names.groupBy("folder", "stem").count().where("count > 1").drop("count"), ["folder", "stem"], "left_semi").withColumn("part", F.expr(f"ordinal div {NAME_PART}")), "names")
    parts = names.groupBy("folder", "stem", "part").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("folder", "stem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    k = F.row_number().over(Window.partitionBy("folder", "stem", "part").orderBy("ordinal")) - 1
    numbered = names.withColumn("r", k).join(before, ["folder", "stem", "part"]).select("ordinal", "folder", "stem", (F.col("r") + F.col("before")).alias("k"))
    md = F.concat(F.lit('---\ntitle: "'), F.col("title"), F.lit('"\ndate: '), F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.lit("\nsource: "), F.col("link"), F.lit("\naccount: "), F.col("account"), F.lit("\n---\n\n"), F.col("content"), F.lit("\n"))
    x = x.join(maybe_broadcast(materialize(numbered.drop("folder", "stem"), "numbers"), 24), "ordinal", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return x.select("ordinal", "folder", F.concat("stem", F.when(F.col("k") > 0, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise(F.lit("")), F.lit(".md")).alias("file_name"), md.alias("markdown"))


def report_totals(plan: DataFrame, total: str = "total") -> DataFrame:
    """K8: (action, n) of a plan's files, and of all of them under the name total; actions without files have no row."""
    n = plan.groupBy("action").agg(F.count("*").alias("n"))
    return n.unionByName(plan.agg(F.count("*").alias("n")).select(F.lit(total).alias("action"), "n"))


def progress_rows(fetched: DataFrame, since: str | None, most: int | None, at: str) -> DataFrame:
    """(account, file_name, since_date, max_articles, fetched_count, updated_at) of each account's run; a null account has none.

    fetched: (account, url) of the articles so far. Their addresses stay rows of that table, not one array an account.
    """
    g = fetched.where("account IS NOT NULL").groupBy("account").agg(F.count("*").alias("fetched_count"))
    name = F.concat(F.lit("progress_"), T.account_file_name("account"), F.lit(".json"))
    return g.select("account", name.alias("file_name"), F.lit(since).cast("string").alias("since_date"), F.lit(most).cast("int").alias("max_articles"), "fetched_count", F.lit(at).alias("updated_at"))


def save_progress(progress: DataFrame, rows: DataFrame) -> DataFrame:
    """Progress with the accounts of rows replaced by them."""
    return progress.join(rows.select("account"), "account", "left_anti").unionByName(rows)


def clear_progress(progress: DataFrame, done: DataFrame) -> DataFrame:
    """Progress without the accounts that are done."""
    return progress.join(done.select("account").distinct(), "account", "left_anti")


def report_rows(plan: DataFrame, most: int = 50) -> DataFrame:
    """K8: the first most files of each action."""
    w = Window.partitionBy("action").orderBy("ord")
    return plan.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= most)


def latest_file(files: DataFrame, pattern: str) -> DataFrame:
    """The newest file whose name matches a glob; ties to the larger path; no row if none matches."""
    rx = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
    return files.where(F.regexp_like("name", F.lit(rx))).agg(F.max(F.struct("mtime", "path")).alias("m")).where("m IS NOT NULL").select("m.path", "m.mtime")
