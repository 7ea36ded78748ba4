"""Spellings of one organisation, or of one person at one ZIP code, linked.

Names become bags of tokens; padded q-grams of the tokens are min-hashed into
bands whose number follows from the collision curve for a wanted recall at the
least similarity variants have.  Names that share a band are verified by
Monge-Elkan similarity over tokens and clustered by star clustering.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, permutations
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.llm import textops as tx
from docketlens.session import discard, spill

Q, RECALL = 3, 0.99
#: Per kind: the least q-gram similarity of a variant to the usual spelling, and min-hashes per band.
TUNED = {"organization": (0.6, 6), "person": (0.48, 3)}
MEAN_SIMILARITY, TOKEN_SIMILARITY = 0.84, 0.68

# Values that name nobody.
NOBODY = frozenset("anonymous anon none na nil self myself me individual private citizen person unknown not applicable provided available given withheld confidential no name n/a test various concerned public retired".split())
# Legal forms and their abbreviations.
FORMS = {
    "association": "assn assoc asociation associaton ass", "corporation": "corp corporaton", "incorporated": "inc incorporatd", "company": "co compnay comp", "limited": "ltd", "council": "cncl coun", "foundation": "fdn fndn found",
    "federation": "fed fedn", "institute": "inst institue", "international": "intl int", "coalition": "coal coaltion", "department": "dept", "university": "univ u", "llc": "llc", "committee": "cmte comm", "society": "soc", "union": "un", "group": "grp",
}
_FORM_OF = {short: full for full, shorts in FORMS.items() for short in [full, *shorts.split()]}
_STOP = frozenset("the of and for a an".split())
_DESK = re.compile(r",\s*(?:hq|headquarters|govt\.? affairs|government affairs|policy dept\.?|policy department|legal dept\.?|public affairs|regulatory affairs|[\w.]+ (?:office|branch|chapter|division))\s*$", re.IGNORECASE)
_INITIALS = re.compile(r"^\s*(?=\S*[A-Z]\S*[A-Z])[A-Za-z]{2,9}\s+[-–—]\s+|\s*\((?=\S*[A-Z]\S*[A-Z])[A-Za-z]{2,9}\)\s*")
_TITLES = frozenset("mr mrs ms miss dr prof rev hon sr sra jr ii iii iv esq phd md".split())
# Given names and their familiar forms.
NICKNAMES = {
    "abigail": "abby gail", "alexander": "alex sasha", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny benji", "catherine": "cathy kate katie cat", "charles": "charlie chuck chas", "christopher": "chris kit topher",
    "cynthia": "cindy cyndi", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "dolores": "lola dolly lolita", "donald": "don donny", "dorothy": "dot dottie", "edward": "ed eddie ted ned", "eleanor": "ellie nell nora nellie",
    "elizabeth": "liz beth betty lizzie eliza libby", "frances": "fran francie frankie", "francisco": "paco pancho", "frederick": "fred freddie freddy", "gabriela": "gaby gabi", "gerald": "gerry jerry", "gregory": "greg", "guadalupe": "lupe lupita",
    "harold": "hal harry", "helen": "nell nellie", "henry": "hank harry", "irene": "rena renie", "isabel": "izzy bella isa", "jacqueline": "jackie jacqui", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "jeffrey": "jeff", "jessica": "jess jessie",
    "john": "jack johnny", "jonathan": "jon jonny", "jose": "pepe chepe", "joseph": "joe joey", "joshua": "josh", "katherine": "kate kathy katie kat", "keiko": "kei", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "len lenny leo", "lourdes": "lulu",
    "margaret": "peggy maggie meg marge margie", "matthew": "matt matty", "michael": "mike mick mikey", "nathaniel": "nate nat nathan", "nicholas": "nick nicky", "olivia": "liv livvy", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy",
    "peter": "pete", "philip": "phil", "phyllis": "phyl", "priya": "pri", "quentin": "quent", "rafael": "rafa rafi", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich richie", "robert": "bob rob bobby robbie", "ronald": "ron ronny",
    "samantha": "sam sammy", "samuel": "sam sammy", "stephanie": "steph stephie", "stephen": "steve", "steven": "steve", "susan": "sue susie", "svetlana": "sveta lana", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim timmy",
    "ursula": "ulla", "victoria": "vicky vicki tori", "vincent": "vince vinny", "virginia": "ginny", "walter": "walt", "wanda": "wendy", "william": "bill will billy willie liam", "xiomara": "xio", "yolanda": "yoli", "yusuf": "joe", "zoe": "zo",
}
_FAMILIAR: dict[str, set[str]] = {}
for _full, _shorts in NICKNAMES.items():
    for _short in [_full, *_shorts.split()]:
        _FAMILIAR.setdefault(_short, set()).add(_full)


def bands(kind: str, recall: float = RECALL) -> int:
    """Number of bands from the collision curve 1 - (1 - s^rows)^bands: names of the least similarity meet with probability ``recall``."""
    least, rows = TUNED[kind]
    return ceil(log(1 - recall) / log(1 - least**rows))


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower().replace("ø", "o").replace("ß", "ss"))
    return "".join(c for c in text if not unicodedata.combining(c))


@lru_cache(maxsize=100_000)
def organisation_tokens(name: str) -> tuple[list[str], list[str]]:
    """(tokens that tell the organisation, its legal forms); both empty for values that name nobody."""
    core = _INITIALS.sub(" ", _DESK.sub("", name))
    text = _plain(core).replace("&", " and ").replace("int'l", "intl").replace("l.l.c", "llc").replace("limited liability company", "llc")
    text = re.sub(r"(?<=\w)['’](?=\w)", "", text)
    tokens = [t for t in re.findall(r"\w+", text) if t not in _STOP]
    if not tokens or all(t in NOBODY for t in tokens):
        return [], []
    told = [t for t in tokens if t not in _FORM_OF]
    # A mistyped "and" or "of" must not keep two spellings apart.
    long = [t for t in told if len(t) > 3]
    told = long if len(long) >= 2 else told
    return told or tokens, [_FORM_OF[t] for t in tokens if t in _FORM_OF]


@lru_cache(maxsize=100_000)
def person_tokens(first: str, last: str) -> list[str]:
    """Name tokens without titles; middle initials are dropped while two other tokens stay."""
    tokens = [t for t in re.findall(r"[^\W\d_]+", _plain(f"{first} {last}".replace("-", "").replace("'", "").replace("’", ""))) if t not in _TITLES]
    if not tokens or all(t in NOBODY for t in tokens):
        return []
    full = [t for t in tokens if len(t) > 1]
    return full if len(full) >= 2 else tokens


def grams(tokens: list[str]) -> set[str]:
    """Padded q-grams of the tokens, regardless of their order."""
    pad = "#" * (Q - 1)
    return {p[i : i + Q] for t in tokens for p in [f"{pad}{t}{pad}"] for i in range(len(p) - Q + 1)}


def band_keys(tokens: list[str], block: str, number: int, rows: int) -> np.ndarray:
    """One key per band of the tokens' min-hash signature, within a block (kind and ZIP code)."""
    base = np.array([xxhash.xxh3_64_intdigest(g) for g in grams(tokens)], dtype=np.uint64)
    seeds = (np.arange(1, number * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    least = tx.mix64(base[None, :] ^ seeds).min(axis=1).reshape(number, rows)
    salt = np.uint64(xxhash.xxh3_64_intdigest(block))
    key = salt + np.arange(number, dtype=np.uint64)
    for r in range(rows):
        key = tx.mix64(key ^ least[:, r])
    return tx.signed(key)


@lru_cache(maxsize=200_000)
def distance(a: str, b: str) -> int:
    """Edits between two words: insertions, deletions, substitutions and swaps of neighbours."""
    if a == b:
        return 0
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


def letters_apart(a: str, b: str) -> int:
    """Letters one word has and the other hasn't; two edits change at most four."""
    return len(set(a) ^ set(b))


def token_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    longer = max(len(a), len(b))
    if abs(len(a) - len(b)) > 2 or longer < 4:
        return 0.0
    if letters_apart(a, b) > 4:
        return 0.0
    edits = distance(a, b)
    return 1 - edits / longer if edits <= (1 if longer < 7 else 2) else 0.0


def monge_elkan(a: list[str], b: list[str], similarity) -> tuple[float, float]:
    """(mean, least) over the tokens of ``a`` of the best similarity to a token of ``b``."""
    best = [max(similarity(x, y) for y in b) for x in a]
    return sum(best) / len(best), min(best)


def same_organisation(x: list[str], x_forms: list[str], y: list[str], y_forms: list[str]) -> bool:
    """Whether two organisations, given by their telling tokens and legal forms, are one."""
    # Different legal forms are different bodies, unless one name leaves the form out.
    if x_forms and y_forms and not set(x_forms) & set(y_forms):
        return False
    forward, back = monge_elkan(x, y, token_similarity), monge_elkan(y, x, token_similarity)
    if min(forward[0], back[0]) >= MEAN_SIMILARITY and min(forward[1], back[1]) >= TOKEN_SIMILARITY:
        return True
    # Words run together or cut apart, in any order: compare what is not shared.
    rest, other = ([t for t in s if t not in o] for s, o in ((x, set(y)), (y, set(x))))
    if abs(len(x) - len(y)) > 2 or not rest or not other or max(forward[0], back[0]) < 0.3:
        return False
    one, two = "".join(rest), "".join(other)
    if abs(len(one) - len(two)) > 2 or letters_apart(one, two) > 4:
        return False
    orders = permutations(rest) if len(rest) <= 3 else [rest]
    return any(distance("".join(o), "".join(p)) <= 2 for o in orders for p in (permutations(other) if len(other) <= 3 else [other]))


def given_similarity(a: str, b: str) -> float:
    if len(a) == 1 or len(b) == 1:
        return 0.85 if a[0] == b[0] else 0.0
    if _FAMILIAR.get(a, set()) & _FAMILIAR.get(b, set()) and (a in NICKNAMES) + (b in NICKNAMES) < 2:
        return 1.0
    # Two names of the list that are close (Jose, Joseph) are still two names.
    if a in NICKNAMES and b in NICKNAMES:
        return 0.0
    if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)):
        return 0.85
    return 0.0 if a in NICKNAMES and b in NICKNAMES else token_similarity(a, b)


def same_person(a: list[str], b: list[str]) -> bool:
    """Family names alike and given names alike, equal by initial or familiar form; in any order."""
    if len(a) < 2 or len(b) < 2:
        return False
    for x in (a, a[::-1]):
        for y in (b, b[::-1]):
            family = token_similarity(x[-1], y[-1]) if len(x[-1]) > 2 and len(y[-1]) > 2 else 0.0
            given = given_similarity(x[0], y[0])
            middle = monge_elkan(x[1:-1], y[1:-1], given_similarity)[1] if len(x) > 2 and len(y) > 2 else 1.0
            if family >= TOKEN_SIMILARITY and given >= TOKEN_SIMILARITY and middle and (family + given) / 2 >= MEAN_SIMILARITY and (family == 1.0 or given == 1.0 or family + given > 1.7):
                return True
    return False


_NODE = pa.schema([("node", pa.int64()), ("bag", pa.int64()), ("kind", pa.string()), ("zip5", pa.string()), ("name", pa.string()), ("n", pa.int64()), ("tokens", pa.string())])
_NODE_SQL = "node long, bag long, kind string, zip5 string, name string, n long, tokens string"


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts)) - (1 << 63)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each stored spelling, and what they make it part of.

    A *node* holds the spellings that read the same (tokens and legal forms; of
    persons, tokens in order), so that they need no comparison.  A *bag* holds the
    nodes with the same tokens in any order, which have one min-hash signature.
    """
    for batch in batches:
        out: tuple[list, ...] = tuple([] for _ in _NODE)
        for kind, zip5, name, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "zip5", "name", "n"))):
            if kind == "organization":
                tokens, forms = organisation_tokens(name)
            else:
                tokens, forms = person_tokens(*name.split("|", 1)), []
                tokens = tokens if len(tokens) > 1 else []
            if not tokens:
                continue
            ordered, text = " ".join(sorted(tokens)), " ".join(tokens)
            told = " ".join(sorted(set(forms)))
            node = _hash(kind, zip5, ordered if kind == "organization" else text, told)
            for column, value in zip(out, (node, _hash(kind, zip5, ordered), kind, zip5, name, n, f"{text}|{told}")):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _NODE.types)], schema=_NODE)


_KEYS = pa.schema([("bag", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _signer():
    number = {kind: bands(kind) for kind in TUNED}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(tokens.partition("|")[0].split(), f"{kind}\x00{zip5}", number[kind], TUNED[kind][1]) for kind, zip5, tokens in zip(*(batch.column(c).to_pylist() for c in ("kind", "zip5", "tokens")))]
            yield pa.RecordBatch.from_arrays([batch.column("bag"), pa.array(keys, pa.list_(pa.int64()))], schema=_KEYS)

    return sign


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = [], []
        for a, b, kind, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "kind", "x", "y"))):
            x, x_forms = (part.split() for part in x.split("|"))
            y, y_forms = (part.split() for part in y.split("|"))
            if same_organisation(x, x_forms, y, y_forms) if kind == "organization" else same_person(x, y):
                left.append(a)
                right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=_EDGE)


def stored_names(comments: DataFrame) -> DataFrame:
    """(kind, zip5, name, n): the distinct stored spellings; NULL and empty organisations and persons without ZIP code are left out."""
    organisations = comments.where("organization is not null and trim(organization) <> ''").groupBy(F.col("organization").alias("name")).agg(F.count("*").alias("n"))
    people = comments.where("zip is not null").select(F.substring("zip", 1, 5).alias("zip5"), F.concat(F.coalesce("first_name", F.lit("")), F.lit("|"), F.coalesce("last_name", F.lit(""))).alias("name")).groupBy("zip5", "name").agg(F.count("*").alias("n"))
    return organisations.select(F.lit("organization").alias("kind"), F.lit("").alias("zip5"), "name", "n").unionByName(people.select(F.lit("person").alias("kind"), "zip5", "name", "n"))


def star_clusters(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, center): star clustering of weighted nodes (id, n).

    The node with most links (then most rows n, then the least id) among its open
    neighbours becomes a star center and takes its open neighbours; rounds repeat
    until no open link is left (each takes at least the greatest open node, so they
    end).  A node between two centers of one round joins the greater.
    """
    both = spill(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "p6-links")
    degree = both.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("links"))
    rank = spill(names.select("id", "n").join(degree, "id").select("id", F.struct("links", "n", (-F.col("id")).alias("id")).alias("rank")), "p6-rank")
    tagged = both.join(rank.select(F.col("id").alias("u"), F.col("rank").alias("ur")), "u").join(rank.select(F.col("id").alias("v"), F.col("rank").alias("vr")), "v")
    left = spill(tagged.select("u", "v", "ur", "vr"), "p6-open0")
    for table in (both, rank):
        discard(table)
    done = None
    for number in count(1):
        if left.isEmpty():
            break
        centers = left.groupBy("u").agg(F.max("vr").alias("top"), F.first("ur").alias("ur")).where("ur > top").select(F.col("u").alias("center"), F.col("ur").alias("rank"))
        taken = left.join(centers.select(F.col("center").alias("v"), "rank"), "v").groupBy("u").agg(F.max_by("v", "rank").alias("center")).select(F.col("u").alias("id"), "center")
        part = spill(taken.unionByName(centers.select(F.col("center").alias("id"), "center")), f"p6-stars{number}")
        done = part if done is None else done.unionByName(part)
        gone = part.select(F.col("id"))
        after = left.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(gone.withColumnRenamed("id", "v"), "v", "left_anti")
        after = spill(after.select("u", "v", "ur", "vr"), f"p6-open{number}")
        discard(left)
        left = after
    if done is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("center")).where("false")
    return done


def linked_nodes(comments: DataFrame) -> DataFrame:
    """(center, kind, zip5, name, n): every stored spelling with the node at the center of its star, or its own."""
    read = spill(stored_names(comments).mapInArrow(_read, _NODE_SQL), "p6-read")
    nodes = read.groupBy("node", "bag", "kind", "zip5").agg(F.min("tokens").alias("tokens"), F.sum("n").alias("n"))
    nodes = spill(nodes, "p6-nodes")
    bags = nodes.groupBy("bag", "kind", "zip5").agg(F.min("tokens").alias("tokens"), F.count("*").alias("nodes"))
    keys = spill(bags.mapInArrow(_signer(), "bag long, keys array<long>").select("bag", F.explode("keys").alias("key")), "p6-keys")
    x, y = keys.alias("x"), keys.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.bag") < F.col("y.bag"))).select(F.col("x.bag").alias("p"), F.col("y.bag").alias("q")).distinct()
    pairs = spill(met.unionAll(bags.where("nodes > 1").select(F.col("bag").alias("p"), F.col("bag").alias("q"))), "p6-pairs")
    discard(keys)
    left = nodes.select(F.col("bag").alias("p"), F.col("node").alias("a"), "kind", F.col("tokens").alias("x"))
    right = nodes.select(F.col("bag").alias("q"), F.col("node").alias("b"), F.col("tokens").alias("y"))
    told = pairs.join(left, "p").join(right, "q").where("p <> q or a < b").select("a", "b", "kind", "x", "y")
    edges = spill(told.mapInArrow(_verify, "a long, b long"), "p6-edges")
    discard(pairs)
    stars = star_clusters(nodes.select(F.col("node").alias("id"), "n"), edges)
    placed = read.join(stars.withColumnRenamed("id", "node"), "node", "left")
    return placed.select(F.coalesce("center", "node").alias("center"), "node", "kind", "zip5", "name", "n")


def linked_names(comments: DataFrame) -> DataFrame:
    """p6: one row per stored spelling that has a variant: kind, zip5, name, entity (the commonest spelling at the star's center) and the number of spellings."""
    linked = spill(linked_nodes(comments), "p6-linked")
    at_center = F.when(F.col("node") == F.col("center"), F.struct("n", "name"))
    titles = linked.groupBy("center").agg(F.count("*").alias("spellings"), F.max(at_center)["name"].alias("entity")).where("spellings > 1")
    return linked.join(titles, "center").select("kind", "zip5", "name", "entity", "spellings")


#: Spellings of one entity that are paired in one task; those of larger entities are spread over pairs of blocks.
PAIR_BLOCK = 500


def name_pairs(comments: DataFrame) -> DataFrame:
    """p6: distinct (kind, zip5, name_a, name_b) of two spellings of one entity, the smaller first."""
    linked = spill(linked_nodes(comments), "p6-linked")
    sizes = linked.groupBy("center").agg(F.count("*").alias("spellings")).where("spellings > 1")
    # A pair meets in the cell of its two blocks only.
    blocks = linked.join(sizes, "center").withColumn("blocks", F.ceil(F.col("spellings") / PAIR_BLOCK).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(name), blocks) as int)"))
    cells = blocks.select("center", "kind", "zip5", "name", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("center", "kind", "zip5", "name", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    x, y = cells.alias("x"), cells.alias("y")
    same = (F.col("x.center") == F.col("y.center")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high")) & (F.col("x.name") < F.col("y.name"))
    own = F.expr("x.low = x.high or x.block <> y.block")
    return x.join(y, same & own).select("x.kind", "x.zip5", F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b"))
