"""Training-data operators against brute force, planted cases and edge cases."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlens.llm import encoding_repair, golay, leakage, name_linkage, near_duplicates, packing, percentiles, personal_data, queries, residue, scan_repair
from docketlens.llm import textops as tx
from docketlens.llm.graph import components
from tests.conftest import CLASHING

WORD = re.compile(r"[^\W_]+")
LONG = "plain words without any end " * 8000
DOC = "doc_id long, text string, lang string, source string, n_chars long, document_number string, doc_type string, crawled_at timestamp_ntz"


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "re", "tu", "sho") for b in ("ban", "dir", "fel", "gom") for c in ("", "ta", "ny", "sk")]


@pytest.fixture
def documents(spark):
    def build(rows, extra=()):
        names = [c.split()[0] for c in DOC.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in [*names, *extra]) for r in rows], DOC + "".join(f", {c} string" for c in extra))

    return build


def edge_comments():
    """NULLs in every column, empty, blank and very long texts, exact repeats, and one repeated id."""
    rows = [{}, {"comment_id": "e1"}, {"comment_id": "e2", "comment_text": "", "attachment_text": " \n\x0c"}, {"comment_id": "e3", "comment_text": LONG, "attachment_text": LONG, "organization": "x" * 3000, "zip": "1"}]
    return rows + [dict(r) for r in rows] + [{"comment_id": "e3", "comment_text": LONG, "first_name": "", "last_name": "", "zip": "", "organization": " "}]


# -- Golay ---------------------------------------------------------------------------------------------------------


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 400)
    keys = golay.fuzzy_keys(words)
    assert set(np.unique((keys >= 0).sum(axis=1))) == {1, 6}
    for a, b in [(i, j) for i in range(23) for j in range(i, 23)]:
        other = golay.fuzzy_keys(words ^ (1 << a) ^ ((1 << b) if b != a else 0))
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(keys, other))


# -- p1 ------------------------------------------------------------------------------------------------------------


def brute_pairs(rows):
    sets = {}
    for r in rows:
        for field in near_duplicates.FIELDS:
            words = WORD.findall((r.get(field) or "").lower())
            if r.get("comment_id") and len(words) >= 25:
                sets.setdefault(field, {}).setdefault(r["comment_id"], set()).update([frozenset(zip(words, words[1:], words[2:]))])
    out = set()
    for field, by_id in sets.items():
        ids = sorted(by_id)
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if any(len(x & y) / len(x | y) >= 0.5 for x in by_id[a] for y in by_id[b]):
                    out.add((field, a, b))
    return out


def test_near_duplicates_against_brute_force(spark, comments, data):
    rng = random.Random(5)
    rows = []
    for c in range(12):
        letter = [prose(rng, 16) for _ in range(9)]
        for v in range(6):
            edited = [list(s) for s in letter]
            rng.shuffle(edited) if v % 3 == 2 else None
            for _ in range(v):
                s = rng.choice(edited)
                s[rng.randrange(len(s))] = "changed"
            if v == 4:
                edited.insert(3, prose(rng, 16))
            rows.append({"comment_id": f"c{c}-{v}", "comment_text": ". ".join(" ".join(s) for s in edited), **{x: "z" for x in CLASHING}})
    rows += [{"comment_id": f"u{i}", "attachment_text": " ".join(prose(rng, 60))} for i in range(40)]
    rows += [{"comment_id": f"same{i}", "comment_text": " ".join(VOCABULARY[:40]).upper() + "!" * i} for i in range(4)]
    rows += edge_comments()
    found = {tuple(r) for r in near_duplicates.near_duplicate_pairs(comments(rows, CLASHING)).collect()}
    true = brute_pairs(rows)
    # A third of the letters have all sentences moved, where few windows stay whole.
    assert found <= true and len(found) >= 0.9 * len(true)
    assert near_duplicates.near_duplicate_pairs(comments([])).count() == 0
    stored = spark.read.parquet(f"{data}/comments_raw.parquet")
    found = {tuple(r) for r in near_duplicates.near_duplicate_pairs(stored).collect()}
    true = brute_pairs([r.asDict() for r in stored.select("comment_id", *near_duplicates.FIELDS).collect()])
    assert found <= true and len(found) >= 0.95 * len(true)


def test_hot_copies_are_spread_and_grouped(comments, monkeypatch):
    monkeypatch.setattr(near_duplicates, "COPIES", 3)
    monkeypatch.setattr(near_duplicates, "GROUP_BLOCK", 2)
    text = " ".join(VOCABULARY[:60])
    rows = [{"comment_id": f"a{i}", "comment_text": text} for i in range(6)] + [{"comment_id": f"b{i}", "comment_text": text + " end" * (i + 1)} for i in range(4)]
    table = comments(rows)
    found = {tuple(r) for r in near_duplicates.near_duplicate_pairs(table).collect()}
    assert found == brute_pairs(rows)
    groups = near_duplicates.near_duplicate_groups(table).collect()
    assert len(groups) == 10 and {r["class_size"] for r in groups} == {10}


def test_moved_sentences_and_hot_keys(comments, monkeypatch):
    """Letters with all sentences moved, and stock letters whose keys are joined instead of paired in place, give the same pairs."""
    rng = random.Random(11)
    rows = []
    for c in range(25):
        letter = [prose(rng, 14) for _ in range(10)]
        for v in range(4):
            moved = [list(x) for x in letter]
            rng.shuffle(moved)
            for _ in range(v):
                x = rng.choice(moved)
                x[rng.randrange(len(x))] = "changed"
            rows.append({"comment_id": f"c{c}-{v}", "comment_text": ". ".join(" ".join(x) for x in moved)})
    table, true = comments(rows), brute_pairs(rows)
    found = {tuple(r) for r in near_duplicates.near_duplicate_pairs(table).collect()}
    assert found <= true and len(found) >= 0.95 * len(true)
    monkeypatch.setattr(near_duplicates, "KEY_ROWS", 1)
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(table).collect()} == found
    monkeypatch.setattr(near_duplicates, "ANCHOR_ROWS", 2)
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(table).collect()} == found


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# -- p2 ------------------------------------------------------------------------------------------------------------


def test_percentiles_select_exactly(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), "x", int(rng.paretovariate(0.4)) if rng.random() > 0.1 else None, "z", "z") for _ in range(4000)] + [("one", None, 7, "z", "z"), ("none", "x", None, "z", "z")] + [("ties", "x", 3, "z", "z")] * 50
    df = spark.createDataFrame(rows, "agency string, submission_channel string, comment_count long, value string, n string")
    groups = ["agency", "submission_channel"]
    got = {(r["agency"], r["submission_channel"]): r for r in percentiles.multi_select(percentiles.partials(df, groups, "comment_count"), groups).collect()}
    values = {}
    for a, s, v, _, _ in rows:
        if v is not None:
            values.setdefault((a, s), []).append(v)
    assert got.keys() == values.keys()
    for key, v in values.items():
        v.sort()
        assert got[key]["n_known"] == len(v)
        for name, q in percentiles.QUANTILES.items():
            assert got[key][name] == v[max(1, math.ceil(round(q * len(v), 9))) - 1]
    # Partials of two halves merge to the same answer; coarse values stay within their bound.
    halves = percentiles.partials(df.where("agency is null or agency < 'b'"), groups, "comment_count", bits=7).unionByName(percentiles.partials(df.where("agency >= 'b'"), groups, "comment_count", bits=7))
    for r in percentiles.multi_select(halves, groups).collect():
        exact = got[(r["agency"], r["submission_channel"])]
        assert all(exact[n] * (1 - 2**-7) <= r[n] <= exact[n] for n in percentiles.QUANTILES)
    assert percentiles.multi_select(percentiles.partials(df.where("false"), groups, "comment_count"), groups).count() == 0


def test_selection_decides_small_groups_and_negative_values(spark):
    values = [-(2**63), -1000, -7, -7, 0, 3, 255, 256, 70000, 2**62]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v long")
    _, found, rounds = percentiles.selected(percentiles.partials(df, ["g"], "v"), ["g"])
    got = {r["q"]: r["value"] for r in found.collect()}
    assert rounds > 0 and got == {q: sorted(values)[max(1, math.ceil(round(q * 10, 9))) - 1] for q in percentiles.QUANTILES.values()}
    short = {r["value"] for r in percentiles.partials(df, ["g"], "v", bits=3).collect()}
    assert short == {-(2**63), -960, -7, 0, 3, 240, 256, 65536, 2**62}


# -- p3 ------------------------------------------------------------------------------------------------------------


def test_encoding_damage_is_found_and_restored(comments):
    clean = "Después el café cobró años a José — “ya es más” — señor niño. El señor así lo pidió, naïve résumé."
    rows = [{"comment_id": f"ok{i}", "comment_text": clean, **{x: "z" for x in CLASHING}} for i in range(30)]
    misread = {"u8-1252": clean.encode().decode("cp1252", "replace").replace("�", "\x9d"), "u8-latin": clean.encode().decode("latin-1"), "mac": clean.replace("—", "-").replace("“", '"').replace("”", '"').encode("cp1252").decode("mac_roman"), "lost": clean.encode("cp1252").decode("utf-8", "replace"), "part": clean + " Y la campaÃ±a."}
    rows += [{"comment_id": k, "attachment_text": v} for k, v in misread.items()] + edge_comments()
    table = comments(rows, CLASHING)
    assert {(r["field"], r["comment_id"]) for r in encoding_repair.damaged_records(table).collect()} == {("attachment_text", k) for k in misread}
    restored = {r["comment_id"]: r["restored"] for r in encoding_repair.restored_records(table).collect()}
    assert restored["u8-latin"] == clean and "años" in restored["lost"] and "Después" in restored["mac"] and restored["part"] == clean + " Y la campaña."
    assert encoding_repair.damaged_records(comments([])).count() == 0
    assert not encoding_repair.is_clean("aÃ±o") and encoding_repair.is_clean("EMISSÃO") and encoding_repair.inverted("CAFÉ”") is None


# -- p5 ------------------------------------------------------------------------------------------------------------


def test_personal_data(comments):
    given, family = ["Maria", "Peter", "Chidi", "Bao", "Helen"], ["Falkumphrey", "Ostiyama", "Dwebarelli", "Jarrowitz", "Kelmandez"]
    people = [{"comment_id": f"p{i}", "first_name": given[i % 5], "last_name": family[(i // 5) % 5], "organization": "Stoneford Landowners Council", "comment_text": f"We object to the rule in every way. Sincerely, {given[i % 5]} {family[(i // 5) % 5]}"} for i in range(50)]
    cases = {
        "email": ["write me at a.b+c@mail.example today", "x.y [at] mail [dot] example", "sam at wire dot example please"],
        "phone": ["call (555) 555-0123 now", "call +44 20 7946 0999 soon", "tel 555.555.0188"],
        "identity_number": ["My SSN is 987-65-4329 here", "passport number A-163-000-136 too"],
        "address": ["I live at 12-3 Old Mill Rd., Unit 4, Umber Springs", "write P.O. Box 123", "at RR 4 Box 81 since"],
        "name": ["Sincerely, Maria Kelmandez", "Dr. Falkumphrey spoke", "Ostiyama, Helen"],
    }
    rows = people + [{"comment_id": f"{k}{i}", "attachment_text": t} for k, ts in cases.items() for i, t in enumerate(ts)]
    none = ["The Harlan-Voss Act of 1977 covers this", "Send it @ noon, they said", "The 555 acres cost $1,204,555", "Docket entry 4471-2209-0038 has it", "Stoneford Landowners Council objects", "Milepost 1420 on Route 9"]
    rows += [{"comment_id": f"none{i}", "attachment_text": t} for i, t in enumerate(none)] + edge_comments()
    table = comments([r | {x: "z" for x in CLASHING} for r in rows], CLASHING)
    got = {}
    for r in personal_data.fields_with_items(table).collect():
        got.setdefault(r["comment_id"], set()).add(r["kind"])
    for kind, texts in cases.items():
        assert all(kind in got.get(f"{kind}{i}", ()) for i in range(len(texts))), kind
    assert not [k for k in got if k.startswith(("none", "e"))  and not k.startswith("email")]
    redacted = {(r["field"], r["comment_id"]): r["redacted"] for r in personal_data.redacted_texts(table).collect()}
    assert redacted["attachment_text", "phone0"] == "call [PHONE] now" and redacted["attachment_text", "none0"] == none[0]
    assert redacted["comment_text", "p0"].endswith("Sincerely, [NAME]") and redacted["comment_text", "e3"] == LONG
    assert personal_data.fields_with_items(comments([])).count() == 0


def test_names_in_small_letters(comments):
    given, family = ["Maria", "Peter", "Chidi", "Bao", "Helen"], ["Falkumphrey", "Ostiyama", "Dwebarelli", "Jarrowitz", "Kelmandez"]
    rows = [{"comment_id": f"p{i}", "first_name": given[i % 5], "last_name": family[(i // 5) % 5], "comment_text": f"We object to the rule in every way. Sincerely, {given[i % 5]} {family[(i // 5) % 5]}"} for i in range(50)]
    cases = ["We object to the rule. Sincerely,\nmaria kelmandez", "The crew chief, chidi jarrowitz, can confirm", "We object. Sincerely, helen vostangulo", "We object. Sincerely, zhanna vostangulo", "ostiyama, helen", "dr. falkumphrey spoke", "all small, no capitals. bao m. dwebarelli"]
    none = ["We object to the grazng alotment in every way", "Sincerely, the neighbors", "They object to maria in every way", "x@y, thanks"]
    rows += [{"comment_id": f"{k}{i}", "attachment_text": t} for k, ts in (("name", cases), ("none", none)) for i, t in enumerate(ts)]
    got = {r["comment_id"] for r in personal_data.fields_with_items(comments(rows)).collect() if r["field"] == "attachment_text"}
    assert got == {f"name{i}" for i in range(len(cases))}


def test_redaction_leaves_no_planted_item(comments):
    """Seeds (announced items) teach forms and contexts by which items that nothing announces are found, in four languages."""
    given, family = ["Maria", "Peter", "Chidi", "Bao", "Helen"], ["Falkumphrey", "Ostiyama", "Dwebarelli", "Jarrowitz", "Kelmandez"]
    streets = ["44 Elm Street, Boise, Idaho 83702", "9 Old Mill Rd., Unit 4, Umber Springs, OR 97001", "Calle Mayor 12, 28013 Madrid", "12 rue de la Paix, 75002 Paris", "Hauptstraße 5, 10115 Berlin"]
    numbers = ["(555) 555-0123", "555-555-0188", "+44 20 7946 0999"]
    rows, planted = [], {}
    for i in range(40):
        name, street, number, mail = f"{given[i % 5]} {family[i // 5 % 5]}", streets[i % 5].replace("12", str(12 + i)), numbers[i % 3], f"box{i}@mail{i % 7}.example"
        text = f"My address is {street} and my phone is {number}, email {mail}." if i % 2 else f"We object to the rule.\n\nSincerely,\n{name}\n{street}\n{number}\n{mail}"
        rows.append({"comment_id": f"c{i}", "first_name": given[i % 5], "last_name": family[i // 5 % 5], "comment_text": text})
        planted[f"c{i}"] = [street, number, mail, *([] if i % 2 else [name])]
    redacted = {r["comment_id"]: r["redacted"] for r in personal_data.redacted_texts(comments(rows)).collect()}
    left = [(k, item) for k, items in planted.items() for item in items if item in redacted[k]]
    assert not left and not [t for t in redacted.values() if re.search(r"\d{3}|Madrid|Paris|Berlin|Idaho|Springs", t)]
    assert redacted["c0"].startswith("We object to the rule.\n\nSincerely,\n[NAME]\n[ADDRESS]")
    assert {r["route"] for r in personal_data.scored_items(comments(rows)).where("kind in ('email', 'address', 'phone')").collect()} == {"seed", "pattern"}


# -- p6 ------------------------------------------------------------------------------------------------------------


def test_names_are_linked(comments):
    org = ["Ivorsedge Millgarth Nurses Council", "Ivorsedge Millgarth Nurses Cncl.", "IVORSEDGE MILLGARTH NURSES COUNCIL", "Nurses Council of Ivorsedge Millgarth", "Ivorsegde Milgarth Nurses Council", "Ivorsedgemillgarth Nurses Council", "The Ivorsedge Millgarth Nurses Council (IMNC)"]
    others = ["Galetarn Vespanthis Credit Services Federation", "N/A", "self", "", " ", "Ivorsedge Oakmanter Timber Company"]
    rows = [{"comment_id": f"o{i}", "organization": o, **{x: "z" for x in CLASHING}} for i, o in enumerate(org + others + org)]
    person = [("William", "Ostiyama"), ("Bill", "Ostiyama"), ("W.", "Ostiyama"), ("Ostiyama", "William"), (None, "Ostiyama, William"), ("William", "Ostiyma")]
    strangers = [("Helen", "Ostiyama"), ("Anonymous", None), ("Anonymous", "Anonymous"), (None, None)]
    rows += [{"comment_id": f"p{i}", "first_name": f, "last_name": l, "zip": "47845-8955"} for i, (f, l) in enumerate(person + strangers)] + [{"comment_id": "q", "first_name": "Bill", "last_name": "Ostiyama", "zip": "00331"}] + edge_comments()
    got = {tuple(r) for r in name_linkage.name_pairs(comments(rows, CLASHING)).collect()}
    want = {("organization", "", a, b) for a in org for b in org if a < b}
    names = [f"{f or ''}|{l or ''}" for f, l in person]
    want |= {("person", "47845", a, b) for a in names for b in names if a < b}
    assert got == want
    assert name_linkage.name_pairs(comments([])).count() == 0
    assert all(1 - (1 - s**r) ** name_linkage.bands(k) >= 0.99 for k, (s, r) in name_linkage.TUNED.items())


def test_common_words_keep_short_names_together(comments):
    """Words of very many organisations stay in the q-grams: short cores with a mistyped common word still meet."""
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    pairs = [(f"{core} growers", f"{core} growrs") for core in {letters(6) for _ in range(40)}]
    others = [f"{letters(9)} growers" for _ in range(400)]
    got = {tuple(r)[2:] for r in name_linkage.name_pairs(comments([{"comment_id": f"c{i}", "organization": o} for i, o in enumerate([*(x for p in pairs for x in p), *others])])).collect()}
    assert got >= set(pairs)


def test_star_clusters_take_the_greatest_center(spark):
    names = spark.createDataFrame([(i, 1) for i in range(8)], "id long, n long")
    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (3, 4), (5, 6)], "a long, b long")
    got = {r["id"]: r["center"] for r in name_linkage.star_clusters(names, edges).collect()}
    assert got[0] == got[1] == got[2] == got[3] == 0 and got[5] == got[6] and got.get(4) in (None, 4)


# -- p7 ------------------------------------------------------------------------------------------------------------

BODY = "every statewide bridge survey would shorten the annual water right before the next fiscal year and nobody on the panel objected to the quarterly licensing test at the hearing in the upper basin during the spring thaw".split()


def page(rng, width=58, hyphenate=False, misread=False):
    words, lines, line = [rng.choice(BODY) for _ in range(110)], [], ""
    for i, w in enumerate(words):
        if misread and i % 30 == 7:
            w = "watcr" if i % 60 == 7 else "0bjected"
        if hyphenate and len(line) + len(w) > width - 2 and len(w) > 5:
            lines.append(f"{line} {w[:3]}-".strip())
            line = w[3:]
        elif len(line) + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line + "."]


def test_scan_noise(comments):
    rng = random.Random(2)
    flat = lambda pages: "\n".join("\n".join(p) for p in pages)
    rows = [{"comment_id": f"ok{i}", "attachment_text": flat([page(rng)]), **{x: "z" for x in CLASHING}} for i in range(60)]
    rows += [{"comment_id": f"hy{i}", "attachment_text": flat([page(rng, hyphenate=True)])} for i in range(20)]
    rows += [{"comment_id": f"mi{i}", "attachment_text": flat([page(rng, misread=True)])} for i in range(20)]
    rows += [{"comment_id": f"hd{i}", "attachment_text": flat([["Comments of Timber Working Group", *page(rng)] for _ in range(3)])} for i in range(20)]
    rows += [{"comment_id": f"pn{i}", "attachment_text": flat([[*page(rng), f"- {n} -"] for n in (1, 2, 3)])} for i in range(20)]
    rows += edge_comments()
    table = comments(rows, CLASHING)
    got = {}
    for r in scan_repair.noise_kinds(table).collect():
        got.setdefault(r["comment_id"], set()).add(r["kind"])
    assert not [k for k in got if k.startswith(("ok", "e"))]
    for prefix, kind in (("hy", "hyphenation"), ("mi", "misread"), ("hd", "running_header"), ("pn", "page_number")):
        assert sum(got.get(f"{prefix}{i}") == {kind} for i in range(20)) >= 19, kind
    fixed = {r["comment_id"]: r["repaired_text"] for r in scan_repair.repaired_texts(table).collect()}
    assert "Comments of Timber" not in fixed["hd0"] and "- 1 -" not in fixed["pn0"] and "\n" not in fixed["hy0"]
    assert set(WORD.findall(fixed["hy0"])) <= set(BODY)
    assert scan_repair.noise_kinds(comments([])).count() == 0


def test_misreadings_in_very_long_words(comments):
    """Words beyond LONG_WORD letters are corrected too, and the sieve loses no token."""
    rng = random.Random(6)
    long = "wasserrechtsbewilligungsverfahren"
    rows = [{"comment_id": f"ok{i}", "attachment_text": "\n".join([f"{long} {page(rng)[0]}", *page(rng)])} for i in range(60)]
    rows += [{"comment_id": "mi", "attachment_text": "\n".join([f"{long.replace('b', '6')} {page(rng)[0]}", *page(rng)])}]
    assert {tuple(r) for r in scan_repair.noise_kinds(comments(rows)).collect()} == {("mi", "misread")}
    assert long in scan_repair.repaired_texts(comments(rows)).first()["repaired_text"]


# -- p8 ------------------------------------------------------------------------------------------------------------


def test_packing_keeps_every_token(documents, monkeypatch):
    monkeypatch.setattr(packing, "MERGE_ROWS", 8)
    rng = random.Random(4)
    rows = [{"doc_id": i, "text": " ".join(prose(rng, int(rng.paretovariate(0.8)) * 9 % 4000 + 1)), **{x: "z" for x in CLASHING}} for i in range(300)]
    rows += [{"doc_id": 900, "text": None}, {"doc_id": 901, "text": ""}, {"doc_id": 902, "text": LONG}, dict(rows[0]), {}]
    table = documents(rows, CLASHING)
    items = packing.packed_items(table.repartition(6)).collect()
    encode = packing.tokenizer(packing.VOCABULARY).encode_ordinary
    want = {}
    for r in rows:
        if r.get("text"):
            want[r.get("doc_id")] = want.get(r.get("doc_id"), 0) + len(encode(r["text"]))
    have, fill = {}, {}
    for i in items:
        have[i["doc_id"]] = have.get(i["doc_id"], 0) + i["tokens"]
        fill[i["container"]] = fill.get(i["container"], 0) + i["tokens"]
        assert i["first_token"] == i["piece"] * packing.CAPACITY
    assert have == want and max(fill.values()) <= packing.CAPACITY
    assert all(fill[i["container"]] == i["fill"] for i in items)
    # Only texts larger than a container are cut.
    assert all(i["piece"] == 0 or want[i["doc_id"]] > packing.CAPACITY for i in items)
    assert len(fill) <= 1.05 * math.ceil(sum(want.values()) / packing.CAPACITY) + 1
    assert packing.packed_items(documents([])).count() == 0 and packing.packing_summary(documents([])).first()["containers"] == 0
    assert packing.best_fit([5, 5, 5], 10) == [[0, 1], [2]]


# -- p9 ------------------------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark, documents, data, monkeypatch):
    def brute(docs, items):
        places, out = {}, set()
        for i, t in items:
            w = WORD.findall((t or "").lower())
            for k in range(len(w) - 11):
                places.setdefault(tuple(w[k : k + 12]), set()).add(i)
        for i, t in docs:
            w = WORD.findall((t or "").lower())
            for k in range(len(w) - 11):
                out |= {(i, x) for x in places.get(tuple(w[k : k + 12]), ())}
        return out

    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")
    true = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert {tuple(r) for r in leakage.leaked_items(docs, items).collect()} == true and true
    monkeypatch.setattr(leakage, "SENT_SHINGLES", 0)
    rng = random.Random(8)
    item = prose(rng, 30)
    rows = [{"doc_id": 1, "text": "Start. " + ", ".join(item[5:17]).upper() + "! end"}, {"doc_id": 2, "text": " ".join(item[5:16] + ["not"] + item[17:27])}, {"doc_id": 3, "text": None}, {"doc_id": 4, "text": ""}, {"doc_id": 5, "text": LONG + " ".join(item)}, {}, {"doc_id": 1, "text": "Start. " + ", ".join(item[5:17]).upper() + "! end"}]
    held = spark.createDataFrame([(7, " ".join(item), "z"), (8, None, "z"), (9, "too short", "z"), (7, " ".join(item), "z")], "item_id long, text string, pos string")
    assert {tuple(r) for r in leakage.leaked_items(documents(rows), held).collect()} == {(1, 7), (5, 7)}
    assert leakage.leaked_items(documents([]), held).count() == 0 and leakage.leaked_items(documents(rows), held.where("false")).count() == 0
    report = {r["doc_id"]: r for r in leakage.leak_report(documents(rows), held).collect()}
    assert (report[1]["windows"], report[1]["leaked_words"], report[5]["leaked_words"]) == (1, 12, 30)


# -- p10 -----------------------------------------------------------------------------------------------------------


def test_residue(documents):
    real = "The panel heard that every phased grant formula draws attention to the tribal water right. Nobody objected to it at the hearing."
    cases = {
        "placeholder": ["Dear {{first_name}}, we write.", "Contact [insert docket_id] at once for details.", "My name is __________ and I live here.", "Signed, %YOUR_NAME%", real + " As a member of [ORGANIZATION], I oppose it."],
        "filler": ["Lorem ipsum dolor sit amet consectetur adipiscing elit.", "Your text here. Your text here.", "asdf qwer asdf qwer asdf qwer"],
        "error_page": ["HTTP 404 - Not Found. The requested document could not be retrieved.", "Access Denied. You don't have permission to view /a/b on this server.", '{"status":503,"error":"Service Unavailable"}'],
        "script_notice": ["Please enable JavaScript to view this page.", "Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen."],
    }
    rows, want, n = [], set(), 0
    for kind, texts in cases.items():
        for text in texts:
            for source in ("a", "b"):
                rows.append({"doc_id": n, "text": text, "source": source, **{x: "z" for x in CLASHING}})
                want.add((n, kind))
                n += 1
    none = [real, real + " Quotes are from the hearing [emphasis added].", real + " Page not found errors are common for rural filers, the survey says.", "Requiring JavaScript on the comment form shuts out people with old phones.", "The set {a, b, c} lists three valves. " + real, None, "", LONG]
    rows += [{"doc_id": 900 + i, "text": t, "source": None} for i, t in enumerate(none)] + [{}]
    table = documents(rows, CLASHING)
    assert {tuple(r) for r in residue.residue_kinds(table).collect()} == want
    clean = residue.without_residue(table)
    assert clean.columns == table.columns and clean.count() == len(none) + 1
    assert residue.residue_kinds(documents([])).count() == 0


def test_residue_within_longer_texts(documents):
    real = "The panel heard that every phased grant formula draws attention to the tribal water right. Nobody objected to it at the hearing in the upper basin. "
    notice = "Please enable JavaScript to view this page."
    latin = "Nostrud aliqua dolor duis magna ullamco amet cupidatat."
    error = "The requested document could not be retrieved from this server " + "and the clerk of the docket is to be asked for it in writing " * 4
    texts = {1: notice, 2: notice, 3: real * 3 + notice, 4: real * 3 + latin, 5: error, 6: real, 7: real * 3 + "Et in fine, non."}
    got = {tuple(r) for r in residue.residue_kinds(documents([{"doc_id": i, "text": t, "source": "ab"[i % 2]} for i, t in texts.items()])).collect()}
    assert got == {(1, "script_notice"), (2, "script_notice"), (3, "script_notice"), (4, "filler"), (5, "error_page")}


def test_residue_broadcasts_nothing_that_grows(documents, monkeypatch):
    """Every join but the one with the few styles of slots is a merge join, whatever the planner thinks of its sides."""
    plans, spill = [], residue.spill
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(residue, "spill", lambda df, name: plans.append(plan(df)) or spill(df, name))
    table = documents([{"doc_id": i, "text": "Error 404: page not found.", "source": "ab"[i % 2]} for i in range(6)])
    clean = residue.without_residue(table)
    joins = [line for p in [*plans, plan(clean)] for line in p.split("\n") if re.search(r"\bJoin\b", line) and "style" not in line]
    assert len(joins) >= 7 and all("strategy=merge" in line for line in joins)
    assert clean.count() == 0


def test_residue_comes_from_recurring_messages(documents):
    """Dates in words are masked; a notice counts where it stands alone elsewhere, prose about such things does not, however often it recurs."""
    assert {residue.mask(t) for t in ("Posted January 5, 2024.", "Posted 5 January 2024.", "Posted 2024-01-05.")} == {"posted 0."}
    assert residue.mask("el 5 de enero de 2024") == residue.mask("el 17 de mayo de 2023") == "el 0"
    real = "The panel heard that every phased grant formula draws attention to the tribal water right. Nobody objected to it at the hearing in the upper basin. "
    trap = "The portal returned error 500 each time I tried to file."
    long = "This page is not available because of work on the server, and " + "the clerk of the docket asks everyone to wait for it, and " * 6 + "that is all."
    texts = [real * 2 + trap] * 4 + [f"Access denied. Posted {m} 5, 2024." for m in ("January", "March")] + [real * 4 + "Access denied."] + [real * 2 + "Ask [TITLE] first."] + [real * 2 + f"Ask [{x}] first." for x in ("AGENCY", "AGENCY")] + [real * 9 + long, long, long]
    got = {tuple(r) for r in residue.residue_kinds(documents([{"doc_id": i, "text": t, "source": "ab"[i % 2]} for i, t in enumerate(texts)])).collect()}
    assert got == {(i, "error_page") for i in (4, 5, 6, 10, 11, 12)} | {(i, "placeholder") for i in (7, 8, 9)}


# -- queries ---------------------------------------------------------------------------------------------------------


def test_columns_of_found_queries(spark, data):
    want = {
        "p1_found": ["field", "comment_id_a", "comment_id_b"], "p3_found": ["field", "comment_id"], "p5_found": ["field", "comment_id", "kind"], "p6_found": ["kind", "zip5", "name_a", "name_b"],
        "p7_found": ["comment_id", "kind"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "kind"],
    }
    for name, columns in want.items():
        df = queries.queries()[name](spark, data)
        assert df.columns == columns and df.count() == df.distinct().count() > 0, name


def test_oracle_statements(spark, data):
    con = duckdb.connect()
    for table in ("federal_register_comments", "documents", "eval_items"):
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, data)
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(map(str, ({c: r[c] for c in sorted(names)} for r in df.collect()))) == sorted(map(str, ({c: r[names.index(c)] for c in sorted(names)} for r in cursor.fetchall()))), name
