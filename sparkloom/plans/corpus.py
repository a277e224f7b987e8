"""From raw posts and comments to an eligible, family-keyed corpus: one lazy plan and its flow table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import rules as R
from ..functions import text as T
from ..functions.time import week_start
from ..operators.aggregates import exclusion_waterfall, unit_or_self
from ..operators.joins import expect_unique, parent_text
from ..operators.windows import group_size, repeated

FIELDS = "id string, platform string, post_type string, raw_text string, username string, timestamp_utc timestamp, thread_id string, parent_id string, source_english boolean"


def with_context(activity: DataFrame) -> DataFrame:
    """Adds clean_text, context_text (the thread's post) and parent_text (the typed parent) to rows of FIELDS."""
    micro = F.col("platform") == "x"
    d = activity.withColumn("clean_text", F.when(micro, T.clean("raw_text", microblog=True)).otherwise(T.clean("raw_text")))
    posts = d.where("post_type = 'reddit_post'")
    comments = d.where("post_type = 'reddit_comment'")
    d = parent_text(d, posts, comments, "parent_id", "id", "clean_text")
    root = posts.groupBy("id").agg(F.max("clean_text").alias("_root"))
    joined = d.join(root.withColumnRenamed("id", "_rid"), (F.col("post_type") == "reddit_comment") & (F.col("thread_id") == F.col("_rid")), "left")
    return joined.select(*d.columns, F.coalesce("_root", F.lit("")).alias("context_text"))


def flagged(d: DataFrame, zone: str = "Asia/Dubai") -> DataFrame:
    """Keys, week, counts and every rule flag; the expensive cue patterns are evaluated once as columns."""
    kind, text = "post_type", "clean_text"
    d = d.withColumns({"record_key": F.concat_ws(":", "platform", kind, "id"), "week": week_start("timestamp_utc", zone), "word_count": T.word_count(text), **R.cues(text)})
    d = d.withColumn("has_context_property_cue", T.has(F.concat_ws(" ", "context_text", "parent_text"), T.phrases(L.DOMAIN_TERMS)))
    sure, unsure = R.promotion(*[F.col(c) for c in ("has_target_property_cue", "contact_cue", "listing_cue", "spec_cue", "solicitation_cue")])
    comment = R.is_comment(kind)
    return d.withColumns(
        {
            "domain_relevant_rule": F.col("has_target_property_cue") | (comment & F.col("has_context_property_cue")),
            "target_promotion_rule": sure, "promotion_ambiguous_flag": unsure,
            "contact_only_rule": R.contact_only(text, kind), "reaction_only_rule": R.reaction_only(text, kind),
            "short_context_flag": comment & (F.col("word_count") <= 5), "known_moderator": R.known_moderator("platform", "username"),
            "generic_username_bot_flag": R.bot_name("username"), "missing_submission_context": comment & (F.col("context_text") == ""),
            "missing_immediate_parent": comment & (F.col("parent_text") == ""), "non_latin_flag": T.text_of(text).rlike(L.NON_LATIN), "text_family": T.family(text),
        }
    )


def waterfall(d: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """The exclusion reason of each row, first rule first."""
    ts = F.col("timestamp_utc")
    return exclusion_waterfall(
        d,
        [
            ("invalid_or_outside_utc_capture_window", ts.isNull() | (ts < F.lit(start).cast("timestamp")) | (ts >= F.lit(end).cast("timestamp"))),
            ("empty_or_deleted_target", (F.col("clean_text") == "") | F.col("raw_text").rlike(f"(?i){L.DELETED}")),
            ("x_non_english_metadata", ~F.coalesce("source_english", F.lit(False))),
            ("known_reddit_automoderator", F.col("known_moderator")),
            ("no_property_evidence", ~F.col("domain_relevant_rule")),
            ("target_solicitation", F.col("target_promotion_rule")),
            ("contact_only", F.col("contact_only_rule")),
            ("reaction_only", F.col("reaction_only_rule")),
        ],
        "post_type",
    )


def families(eligible: DataFrame) -> DataFrame:
    """Author keys, family sizes, same-author repeats and one training representative a family."""
    d = eligible.withColumn("author_key", unit_or_self("_author", "record_key")) if "_author" in eligible.columns else eligible.withColumn("_author", T.author_key("username")).withColumn("author_key", unit_or_self("_author", "record_key"))
    return d.drop("_author").withColumns(
        {
            "exact_family_size": group_size("platform", "text_family"),
            "author_repeat": repeated(["platform", "author_key", "text_family"], "timestamp_utc", "record_key"),
            "training_representative": ~repeated(["text_family"], "timestamp_utc", "record_key"),
            "training_key": F.col("text_family"),
        }
    )


def build(activity: DataFrame, start: str, end: str, zone: str = "Asia/Dubai", repair_offers: bool = True) -> tuple[DataFrame, DataFrame]:
    """(eligible rows, flow). Record keys must be unique; open offers are taken out of the eligible rows at the end."""
    d = flagged(with_context(activity), zone)
    expect_unique(d.select("record_key"), ["record_key"], "activity")
    rows, flow = waterfall(d, start, end)
    good = rows.where("eligible")
    if repair_offers:
        good = good.where(R.explicit_offer("clean_text") == "")
    return families(good), flow
