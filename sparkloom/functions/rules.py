"""Rule-based flags over text columns. Flags are never null: a missing text is an empty one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import author_key, bounded_hits, dup_key, has, phrases, repeat_key, space_words, substring_hits, text_key, text_of, whole, word_count

REDDIT_COMMENT = "reddit_comment"


def is_comment(kind: Column | str) -> Column:
    """Whether a kind is that of a comment; a null kind is not."""
    return text_of(kind) == REDDIT_COMMENT


def cues(text: Column | str) -> dict[str, Column]:
    """The five cue flags of a text, by name."""
    return {
        "has_target_property_cue": has(text, phrases(L.DOMAIN_TERMS)),
        "contact_cue": has(text, phrases(L.CONTACT)),
        "listing_cue": has(text, phrases(L.LISTING)),
        "spec_cue": has(text, L.SPEC),
        "solicitation_cue": has(text, L.SOLICIT),
    }


def promotion(property_cue: Column, contact: Column, listing: Column, spec: Column, solicit: Column) -> tuple[Column, Column]:
    """(promotion, ambiguous): a target's own words decide; what a parent says never makes it an advertisement."""
    sure = (contact & (property_cue | spec | listing)) | (listing & spec & solicit)
    return sure, (contact | listing | solicit) & ~sure


def relevance(text: Column | str, context: Column | str, kind: Column | str) -> Column:
    """A text names the domain, or is a comment whose context does."""
    domain = phrases(L.DOMAIN_TERMS)
    return has(text, domain) | (is_comment(kind) & has(context, domain))


def contact_only(text: Column | str, kind: Column | str) -> Column:
    """A comment of at most 14 words that says nothing but contact words."""
    return is_comment(kind) & whole(text, L.CONTACT_ONLY) & (word_count(text) <= 14)


def reaction_only(text: Column | str, kind: Column | str) -> Column:
    """A comment of at most three words that is one reaction."""
    return is_comment(kind) & whole(text, phrases(L.REACTION)) & (word_count(text) <= 3)


def known_moderator(platform: Column | str, author: Column | str) -> Column:
    """The moderation account of the forum, however its name is written; a human who is named like it in part is not."""
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace(text_of(author), r"(?U)^\s+|\s+$", ""))), "^/?u/", "")
    return (text_of(platform) == "reddit") & (name == "automoderator")


def bot_name(author: Column | str) -> Column:
    """A name that sounds like a program."""
    return has(author, L.BOT_NAME)


def spam_without_domain(text: Column | str) -> Column:
    """Two noise cues or more and no term of the domain."""
    return (F.size(substring_hits(text, L.NOISE_CUES)) >= 2) & (F.size(bounded_hits(text, L.DOMAIN_TERMS)) == 0)


def long_or_domain(text: Column | str, words: int = 3) -> Column:
    """Enough words, or any term of the domain."""
    return (space_words(text) >= words) | (F.size(bounded_hits(text, L.DOMAIN_TERMS)) > 0)


def agent_listing(text: Column | str, terms: list[str] | None = None, least: int = 2) -> Column:
    """The first listing rule: ``least`` cues or more anywhere."""
    return F.size(substring_hits(text, terms or L.AGENT_LISTING_CUES)) >= least


def domain_listing_keep(text: Column | str, domain: list[str] | None = None, most_noise: int = 1, least: int = 2) -> dict[str, Column]:
    """The flags is_domain_relevant, is_likely_agent_listing and keep of the first filter."""
    relevant = (F.size(substring_hits(text, domain or L.DOMAIN_TERMS)) > 0) & (F.size(substring_hits(text, L.NOISE_CUES)) <= most_noise)
    listing = agent_listing(text, least=least)
    return {"is_domain_relevant": relevant, "is_likely_agent_listing": listing, "keep": relevant & ~listing}


def _refined(strong: Column, weak: Column, protection: Column, contact: Column) -> Column:
    listing = contact | (strong >= 2) | ((strong >= 1) & (weak >= 1)) | ((weak >= 4) & (protection == 0))
    return listing & ~((protection >= 1) & (strong == 0) & ~contact)


def refined_listing(text: Column | str, strong: list[str] | None = None, weak: list[str] | None = None, protection: list[str] | None = None) -> Column:
    """Two strong cues, or a strong with a weak one, or four weak ones; analysis words shield texts without strong cues.

    The lists are those of the second rule unless given."""
    counts = (F.size(substring_hits(text, x)) for x in (strong or L.STRONG_LISTING_2, weak or L.WEAK_LISTING, protection or L.ANALYSIS_2))
    return _refined(*counts, F.lit(False))


def refined_listing_with_contact(text: Column | str, context: Column | str, kind: Column | str, strict_reference: bool = False) -> Column:
    """The third rule: short contact comments (by their own ``text``) are listings and are never shielded; cues count in ``context``,
    the text with what surrounds it."""
    counts = (F.size(substring_hits(context, x, text_key)) for x in (L.STRONG_LISTING_3, L.WEAK_LISTING, L.ANALYSIS_3))
    return _refined(*counts, short_contact_comment(text, kind, strict_reference))


def short_contact_comment(text: Column | str, kind: Column | str, strict_reference: bool = False) -> Column:
    """A line that only asks for contact, or at most five words with a contact word.

    ``strict_reference`` keeps the literal effect of an operator-precedence slip: one word with a cue, or none without.
    """
    line = text_of(text).rlike("(?iuU)^(?:" + "|".join(rf"\s*{p}\s*$" for p in L.CONTACT_LINES) + ")")
    cue = has(text_key(text), L.SHORT_CONTACT_WORDS)
    n = word_count(text)
    short = (n <= F.when(cue, F.lit(1)).otherwise(F.lit(0))) if strict_reference else ((n <= 5) & cue)
    return is_comment(kind) & (line | short)


def low_information(text: Column | str, kind: Column | str) -> Column:
    """A comment that is a stock phrase, a short contact line or a notice of removal."""
    exact = text_key(text).isin(*L.LOW_INFO_EXACT)
    return is_comment(kind) & (exact | ((word_count(text) <= 8) & has(text, L.CONTACT_NOISE)) | has(text, L.MODERATOR_NOTICE))


def extra_contact_variant(text: Column | str, kind: Column | str) -> Column:
    """A comment that is a stock contact line, or at most 25 words with a contact phrase."""
    return is_comment(kind) & (dup_key(text).isin(*L.EXTRA_LOW_INFO_EXACT) | ((word_count(text) <= 25) & has(text, L.EXTRA_CONTACT)))


def removal(moderator: Column, extra_contact: Column, same_author_repeat: Column, near_repeat: Column) -> Column:
    """Near-duplicate repeats are flagged but never removed, so the last argument has no effect by design."""
    return moderator | extra_contact | same_author_repeat


def explicit_offer(text: Column | str) -> Column:
    """The first of five kinds of open offer, or the empty string."""
    t = text_of(text)
    opening = F.substring(t, 1, L.OFFER_OPENING)
    specs = sum((has(t, p).cast("int") for p in L.OFFER_SPECS), F.lit(0))
    request = has(opening, L.OFFER_REQUEST)
    detailed = (specs >= 2) & ~request
    return (
        F.when(has(t, L.OFFER_DIRECT) & has(t, L.OFFER_SERVICE) & ~has(t, L.OFFER_DIRECT_NOT) & has(t, L.OFFER_DIRECT_OWN), "explicit_contact_invitation")
        .when(has(t, L.OFFER_BROKER) & has(t, L.OFFER_BROKER_OWN), "broker_inventory_offer")
        .when(has(t, L.OFFER_WORDS) & has(opening, L.OFFER_HEADER) & detailed & ~has(t, r"^\W*any\b"), "explicit_property_offer")
        .when(has(t, L.OFFER_SALES) & detailed, "explicit_sales_marketing")
        .when(has(t, L.OFFER_PHONE) & detailed, "explicit_phone_offer")
        .otherwise("")
    )


def last_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """The value of the last rule that holds."""
    out = F.lit(default)
    for mask, value in rules:
        out = F.when(F.coalesce(mask, F.lit(False)), F.lit(value)).otherwise(out)
    return out


def first_match(rules: list[tuple[Column, str]], default: str | None) -> Column:
    """The value of the first rule that holds; a null condition does not."""
    out = F.lit(default) if default is not None else F.lit(None).cast("string")
    for mask, value in reversed(rules):
        out = F.when(F.coalesce(mask, F.lit(False)), F.lit(value)).otherwise(out)
    return out


def triage(text: Column | str, parent: Column | str, author: Column | str, geo_source: Column | None = None, reasons: bool = False) -> Column:
    """Where a noise record goes for review, or with ``reasons`` why; later routes overrule earlier ones."""
    own, ctx = repeat_key(text), repeat_key(parent)
    own_prop, par_prop = has(own, L.TRIAGE_PROPERTY), has(ctx, L.TRIAGE_PROPERTY)
    geo = has(own, L.TRIAGE_GEO) | has(ctx, L.TRIAGE_GEO) | (geo_source if geo_source is not None else F.lit(False))
    n = space_words(own)
    features = F.size(F.array_distinct(F.regexp_extract_all(own, F.lit("(?iuU)" + L.TRIAGE_FEATURES), F.lit(0))))
    politics = geo & has(own, L.TRIAGE_POLITICS) & ~own_prop & ~par_prop
    vehicle = has(own, L.TRIAGE_VEHICLE) & ~has(own, L.TRIAGE_HOUSING)
    selling = (has(own, L.TRIAGE_CONTACT) & has(own, L.TRIAGE_OFFER)) | has(own, L.TRIAGE_MARKETING) | ((features >= 4) & has(own, L.TRIAGE_PRICE))
    routes = [
        (politics, "geopolitics_excluded_no_property_link"),
        ((ctx != "") & par_prop & ~own_prop & ~politics, "context_dependent"),
        (geo & own_prop & (n >= 12) & ~vehicle, "property_discussion_candidates"),
        (geo & own_prop & (n < 12), "short_property_context_needed"),
        (geo & (own_prop | par_prop) & selling, "property_promotion_candidates"),
        (has(author_key(author), L.TRIAGE_BOT_NAME) | F.contains(own, F.lit(L.TRIAGE_BOT_NOTICE)), "automated_candidates"),
    ]
    if not reasons:
        return last_match(routes, "uncertain_or_other")
    return last_match([(mask, TRIAGE_REASONS[name]) for mask, name in routes], TRIAGE_REASONS["uncertain_or_other"])


#: Why a record takes a route.
TRIAGE_REASONS = {
    "geopolitics_excluded_no_property_link": "Politics of the region, and neither the record nor its parent names property; the exclusion can be reviewed.",
    "context_dependent": "Only the parent names property: what the record adds shows in its conversation.",
    "property_discussion_candidates": "Names property and the region in twelve words or more: a candidate, not an acceptance.",
    "short_property_context_needed": "Names property and the region in fewer than twelve words: to be read in context.",
    "property_promotion_candidates": "Property in context with an offer and contact, open marketing or the form of a listing: a candidate, not a label.",
    "automated_candidates": "A known bot or a notice of automated action.",
    "uncertain_or_other": "No rule finds enough evidence of property; relevant records may remain here.",
}


def contains_class(label: Column | str, word: str) -> Column:
    """Whether a label names a class: equal to ``word``, or holding it anywhere, case aside; a null label is neither."""
    return F.contains(F.lower(text_of(label)), F.lit(word.lower()))


def mapped_label(label: Column | str, names: dict[str, str], default: str | None = None) -> Column:
    """A display name for a coded label; a code that has none keeps itself, or ``default`` where that is given."""
    c = text_of(label)
    return first_match([(c == code, name) for code, name in names.items()], default) if default is not None else F.coalesce(first_match([(c == code, name) for code, name in names.items()], None), c)


def sampling_stratum(topic: Column | str, text: Column | str, context: Column | str, filler: Column) -> Column:
    """The stratum that a record is drawn from for review: the first that fits."""
    topic = F.col(topic) if isinstance(topic, str) else topic
    short, contact = space_words(text) < 12, has(text, L.STRATUM_CONTACT)
    assigned = topic != -1
    return first_match(
        [
            (assigned & (short | contact), "assigned_short_or_contact"),
            (assigned, "assigned_other"),
            (filler, "outlier_repeated_filler"),
            (contact, "outlier_contact"),
            (has(text, L.STRATUM_PROPERTY), "outlier_own_property_word"),
            (has(context, L.STRATUM_PROPERTY), "outlier_context_only_property_word"),
            (short, "outlier_short_no_detected_property_link"),
        ],
        "outlier_other",
    )


def district(text: Column | str, names: list[tuple[str, str]], default: str = "General") -> Column:
    """The first (needle, name) whose needle the lower-cased text contains."""
    t = F.lower(text_of(text))
    return first_match([(F.contains(t, F.lit(n.lower())), name) for n, name in names], default)


