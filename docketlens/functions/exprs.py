"""Column builders: every scalar rule as a native expression, NULL-safe under ANSI mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five labels in display order, and the spellings that mean them.
CATEGORIES = [
    "Undecided/Anonymous",
    "Ordinary Citizen",
    "Large Organization/Corporation",
    "Academic/Industry/Expert (incl. small/local business)",
    "Political Consultant/Lobbyist",
]
UNDECIDED, CITIZEN, ORGANIZATION, EXPERT, LOBBYIST = CATEGORIES
SPELLINGS = {
    UNDECIDED: ("Undecided/Anonymous", "undecided"),
    CITIZEN: ("Ordinary Citizen", "citizen"),
    ORGANIZATION: ("Organization/Corporation", "organization", "corporation"),
    EXPERT: ("Academic/Industry/Expert (incl. small/local business)", "expert", "academic"),
    LOBBYIST: ("Political Consultant/Lobbyist", "lobbyist", "consultant"),
}
# Labels as the labelling step writes them.
WRITTEN_ORGANIZATION = "Organization/Corporation"
# Words that tell the kind of an author (matched as substrings), and words too common to keep as tokens.
COMPANY_WORDS = ("inc", "llc", "corp", "company", "association", "coalition", "group", "council")
BUSINESS_TYPES = ("organization", "company", "business")
SCHOLAR_WORDS = ("university", "college", "institute", "research", "lab", "dept", "department")
ADVISER_WORDS = ("consulting", "consultancy", "partners", "solutions", "services")
STOPWORDS = ("the", "and", "for", "with", "this", "that", "from", "have", "has", "are", "was", "were", "been", "will")
BINS = [("0-10", 10), ("11-100", 100), ("101-1000", 1000), ("1001-10000", 10000), ("10000+", None)]
VOLUMES = [("1", 1), ("2-5", 5), ("6-10", 10), ("11-50", 50), ("51-100", 100), ("100+", None)]
LEVELS = (10, 25, 40, 60)
SPACE = r"(?U)^\s+|\s+$"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x: Column | str) -> Column:
    """NULL for NULL and the empty string."""
    return F.nullif(c(x), F.lit(""))


def first_filled(*columns: Column | str) -> Column:
    return F.coalesce(*[filled(x) for x in columns])


def stripped(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c(x), SPACE, "")


def steps(value: Column, table: list[tuple[str, int | None]]) -> Column:
    """Label of the first step whose upper bound is not below the value; the last label for the rest and for NULL."""
    out = None
    for label, top in table[:-1]:
        out = F.when(value <= top, label) if out is None else out.when(value <= top, label)
    return out.otherwise(table[-1][0])


def comment_bin(count: Column | str) -> Column:
    return steps(c(count), BINS)


def volume_bin(count: Column | str) -> Column:
    """Right-closed volume classes; 0 and NULL are in none."""
    return F.when(c(count) > 0, steps(c(count), VOLUMES))


def engagement_level(rate: Column | str) -> Column:
    """0 to 4 by left-closed thresholds; NULL is 0."""
    return sum((F.when(c(rate) >= t, 1).otherwise(0) for t in LEVELS), F.lit(0)).cast("int")


def contains_any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (x.contains(w) for w in words))


def submission_channel(regs_id: Column | str, url: Column | str) -> Column:
    """Where comments are sent, by document id and URL; the first rule that holds counts."""
    low = F.lower(F.coalesce(c(url), F.lit("")))
    return (
        F.when(filled(regs_id).isNotNull(), "regs.gov")
        .when(low == "", "unknown")
        .when(low.contains("regulations.gov"), "regs.gov")
        .when(low.contains("ecfs.fcc.gov"), "fcc-ecfs")
        .when(low.contains("efiling.ferc.gov"), "ferc-portal")
        .when(low.contains("www.sec.gov/comments"), "sec-portal")
        .when(low.startswith("mailto:"), "email")
        .when(low.startswith("http"), "other-portal")
        .otherwise("unknown")
    )


def count_cascade(regs: Column, listed: Column, register: Column, has_regs: Column) -> tuple[Column, Column]:
    """(count, source): the first usable of three counts; 0 where a document id exists but no count does."""
    usable = [F.when(x >= 0, x) for x in (regs, listed, register)]
    count = F.when(has_regs, F.coalesce(*usable, F.lit(0).cast("long")))
    source = F.when(~has_regs, "unknown").when(usable[0].isNotNull(), "regulations.gov").when(usable[1].isNotNull(), "regulations.gov-meta").when(usable[2].isNotNull(), "federalregister").otherwise("unknown")
    return count, source


def known_category(category: Column | str) -> Column:
    """One of CATEGORIES, or NULL for an unknown label."""
    out = None
    for label, spellings in SPELLINGS.items():
        hit = c(category).isin(*{*spellings, label})
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def category_order(category: Column | str) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in CATEGORIES]), c(category)).cast("int")


def author_rule(org: Column | str, first: Column | str, last: Column | str, gov: Column | str, kind: Column | str) -> Column:
    """Author type from metadata alone, NULL where no rule holds; the words match anywhere in the lower-case value."""
    o, f, g, k = filled(org), F.coalesce(filled(first), filled(last)), filled(gov), F.lower(filled(kind))
    low = F.lower(o)
    return (
        F.when(o.isNotNull() & f.isNull() & contains_any(low, COMPANY_WORDS), WRITTEN_ORGANIZATION)
        .when(g.isNotNull(), EXPERT)
        .when(contains_any(k, BUSINESS_TYPES), WRITTEN_ORGANIZATION)
        .when(k.contains("individual") & o.isNull(), CITIZEN)
        .when(o.isNotNull() & f.isNotNull() & contains_any(low, SCHOLAR_WORDS), EXPERT)
        .when(o.isNotNull() & f.isNotNull() & contains_any(low, ADVISER_WORDS), EXPERT)
    )


def main_agency(agency: Column | str) -> Column:
    """First of the comma-joined levels; Unknown for NULL and empty."""
    first = F.trim(F.get(F.split(c(agency), ","), F.lit(0)))
    return F.when(filled(agency).isNull(), "Unknown").otherwise(first)


def sub_agency(agency: Column | str) -> Column:
    """The levels after the first, NULL if there are none."""
    parts = F.transform(F.split(c(agency), ","), lambda x: F.trim(x))
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1))), ", "))


def quadrant(x: Column, y: Column) -> Column:
    return F.when((x >= 0) & (y >= 0.5), 1).when((x < 0) & (y >= 0.5), 2).when((x >= 0) & (y < 0.5), 3).otherwise(4)


def reply_label(reply: Column | str) -> Column:
    """Label named by a model's reply: the first key word it contains, undecided if none."""
    low = F.lower(stripped(F.coalesce(c(reply), F.lit(""))))
    out = F.when(low == "", UNDECIDED)
    for word, label in (("undecided", UNDECIDED), ("citizen", CITIZEN), ("org", WRITTEN_ORGANIZATION), ("expert", EXPERT), ("lobbyist", LOBBYIST)):
        out = out.when(low.contains(word), label)
    return out.otherwise(UNDECIDED)


def fetch_rate(strategy: str, count: Column) -> Column:
    """Share of a document's comments to fetch: all, a tenth, or by size."""
    if strategy == "all":
        return F.lit(1.0)
    if strategy == "sample":
        return F.lit(0.1)
    return F.when(count <= 1000, 1.0).otherwise(F.try_divide(F.least(F.lit(5000), F.floor(count * F.lit(0.1))).cast("double"), count.cast("double")))


def has_text(*columns: str) -> Column:
    """Whether any column holds more than white space."""
    return reduce(lambda a, b: a | b, (F.regexp_replace(F.coalesce(F.col(x), F.lit("")), r"(?U)\s", "") != "" for x in columns))


def combined_text(*columns: str) -> Column:
    """Trimmed texts joined by a blank line; empty ones and the word none are left out."""
    parts = [stripped(F.col(x)) for x in columns]
    return F.concat_ws("\n\n", *[F.when((p != "") & (F.lower(p) != "none"), p) for p in parts])


def tokens(text: Column | str) -> Column:
    """Lower-case words of at least three letters a-z, stopwords left out."""
    found = F.split(F.lower(F.coalesce(c(text), F.lit(""))), r"[^\p{L}\p{N}\p{M}_]+")
    return F.filter(found, lambda x: x.rlike("^[a-z]{3,}$") & ~x.isin(*STOPWORDS))


def sample_size(population: Column, confidence: float = 0.95, error: float = 0.05) -> Column:
    """Finite-population sample size for a proportion of one half; the whole population below ten."""
    z = 1.96 if confidence == 0.95 else 2.576
    unlimited = z * z * 0.5 * 0.5 / (error * error)
    corrected = F.floor(F.lit(unlimited) / (1 + (F.lit(unlimited) - 1) / F.greatest(population, F.lit(1)).cast("double"))) + 1
    return F.when(population <= 0, 0).when(population < 10, population).otherwise(F.least(corrected, population)).cast("long")


def draw_key(seed: int, *columns: str) -> Column:
    """Reproducible random order: MD5 of the seed and the row's keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *[F.col(x) for x in columns])))


def iso_date(x: Column | str) -> Column:
    """Date of an ISO text, NULL for malformed values."""
    return F.when(c(x).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(c(x), 1, 10), "yyyy-MM-dd"))
