"""The training-data operators against brute force on small tables with the awkward cases in them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row, functions as F

from rubrica.llm import exact, fingerprint, forest, lines, packing, passages, pieces, private, quality, tokens
from rubrica.llm.base import bare

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n)]


BASE = _words(120, 1)
NEAR = [*BASE[:60], "changed", *BASE[61:]]
PASSAGE = " ".join(_words(60, 2))
TEXTS = {
    1: " ".join(BASE), 2: " ".join(BASE), 3: " ".join(NEAR), 4: None, 5: "", 6: "one two",
    7: "One TWO", 8: "  a  b \n\tc ﬁ ① é <s> <|endoftext|> x", 9: "x" * 3000, 10: "word " * 4000,
    11: " ".join(_words(40, 3)) + " " + PASSAGE + " " + " ".join(_words(30, 4)),
    12: " ".join(_words(25, 5)) + " " + PASSAGE + " " + " ".join(_words(50, 6)),
    13: "\n".join(["first line", "second line", "third line", *(" ".join(_words(6, k)) for k in range(20, 60))]),
    14: "\n".join(["new", *(" ".join(_words(6, k)) for k in range(20, 60)), "end"]),
    15: "mail a@b.com_x@y.org 😀 1.2.3.4.5 256.1.1.1 no 4111 1111 1111 1111 +1 (555) 123-4567",
    16: " ".join(_words(2500, 7)) + "\n①" * 50,
}
ROWS = [(i, t, "en", "src", len(t or ""), "clash", "clash") for i, t in TEXTS.items()]
ROWS += [ROWS[0], (None, "null id text", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(docs):
    # A bound of 2,000 bytes makes the buckets recurse; the answer must not change.
    for memory in (exact.MEMORY, 2000):
        rows = exact.exact_dedup(docs, memory).collect()
        assert len(rows) == len(ROWS)
        groups = Counter(t or "" for _, t, *_ in ROWS)
        top = {}
        for i, t, *_ in ROWS:
            top[t or ""] = max(top.get(t or "", -1), -1 if i is None else i)
        for r in rows:
            t = TEXTS.get(r.doc_id, "null id text") or ""
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
            assert r.group_size == groups[t]
            assert r.keep_id == (None if top[t] == -1 else top[t])
            assert r.kept == (r.doc_id == r.keep_id)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BYTES)
    rows = packing.pack(docs, BYTES, 64).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for k, parts in sequences.items():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at == 64 or k == len(sequences) - 1
    whole = {i: [*model.encode(t or "", add_special_tokens=False).ids, 0] for i, t in TEXTS.items()}
    for r in rows:
        if r.doc_id is not None:
            ids = whole[r.doc_id]
            assert r.doc_tokens == len(ids)
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    total = sum(len(v) for v in whole.values()) + len(whole[1])
    assert sum(r.length for r in rows if r.doc_id is not None) == total


def test_token_counts_and_pieces(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for chunk, overlap in ((tokens.CHUNK, tokens.OVERLAP), (90, 4), (300, 40)):
        counted = _by_id(tokens.count_tokens(docs, PIECES, 100, chunk, overlap))
        for i, t in TEXTS.items():
            n = len(model.encode(t or ""))
            assert (counted[i].n_tokens, counted[i].over_limit) == (n, n > 100)
            assert counted[i].n_bytes == len((t or "").encode())
    digests = _by_id(pieces.piece_digests(docs, PIECES))
    for i, t in TEXTS.items():
        ids = model.encode(t or "")
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def _sets() -> dict:
    out = {}
    for i, t in TEXTS.items():
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        out[i] = grams or ({tuple(w)} if w else set())
    return out


def test_near_dedup(docs):
    rows, sets = _by_id(forest.near_dedup(docs)), _sets()
    low = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    low[i] = min(low[i], low[j])
    for i, s in sets.items():
        assert (rows[i].n_shingles, rows[i].component_id) == (len(s), low[i])
        assert rows[i].kept == (i == low[i])
    assert rows[None].component_id is None


def test_star_of_near_copies(spark, docs):
    """Variants that are linked with their common source only still form one component."""
    rng = random.Random(8)
    source = _words(300, 9)
    rows = [(0, " ".join(source))]
    for k in range(1, 60):
        w = list(source)
        for p in rng.sample(range(300), 7):
            w[p] = f"edit{k}x{p}"
        rows.append((k, " ".join(w)))
    got = forest.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_passages(docs):
    rows = passages.repeated_passages(docs).collect()
    found = {r.doc_id: r for r in rows if r.n_words >= 16 and r.doc_id in (11, 12)}
    assert found[12].keep_id == found[11].keep_id == 11
    assert found[11].kept and not found[12].kept
    for i in (11, 12):
        assert TEXTS[i][found[i].start : found[i].end] in PASSAGE
    near = {r.doc_id for r in rows if r.kind == "line" and r.keep_id == 1}
    assert {1, 2, 3} <= near
    assert not {4, 5, 6, 7, 9, 15, 16} & {r.doc_id for r in rows}


def test_passages_keep_a_copy_of_each(spark):
    """A heading that many documents share chains no passages: each stays where it stands first."""
    head = " ".join(_words(30, 40))
    quotes = [" ".join(_words(40, 41 + k)) for k in range(3)]
    own = [" ".join(_words(25, 50 + k)) for k in range(9)]
    texts = {0: f"{head}\n{own[0]}"}
    for k, q in enumerate(quotes):
        for i in (1 + 2 * k, 2 + 2 * k):
            texts[i] = f"{own[i]}\n{head}\n{q}\n{own[i][::-1]}"
    rows = passages.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    left = dict(texts)
    for r in sorted(rows, key=lambda r: -r.start):
        if not r.kept:
            left[r.doc_id] = left[r.doc_id][: r.start] + left[r.doc_id][r.end :]
    for k, q in enumerate(quotes):
        assert q in left[1 + 2 * k]
        assert len(set(q.split()) & set(left[2 + 2 * k].split())) < 16
    assert head in left[0] and not any(head in left[i] for i in range(1, 7))


def test_lines_of_one_band_all_meet(spark):
    """Lines with a common head collide in bands; like pairs among them are found, whatever the ends are."""
    head = _words(60, 60)
    texts = {}
    for k in range(40):
        tail = _words(12, 100 + k)
        texts[2 * k] = " ".join(head + tail)
        texts[2 * k + 1] = " ".join(head + tail + ["end"])
    rows = passages.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    classes = {r.doc_id: r.class_id for r in rows.filter("kind = 'line'").collect()}
    # Pairs that share no band are out of reach: 0.7 percent at a likeness of 0.75.
    assert sum(classes.get(2 * k, -1) == classes.get(2 * k + 1, -2) for k in range(40)) == 40


def test_links_of_a_large_band_stay_few(spark):
    """Families of like lines in the same bands: each is joined by about one link per line, not by all its pairs."""
    head, texts = _words(60, 70), []
    for family in range(3):
        tail = _words(30, 71 + family)
        texts += [" ".join([*head, *tail[:-1], f"end{family}x{k}"]) for k in range(60)]
    rows = bare(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).withColumn("_d", F.xxhash64("doc_id"))
    pieces = rows.mapInArrow(passages._parse, passages._PIECE).filter("at < 0")
    assert passages._paragraph_links(pieces, rows).distinct().count() < 5 * len(texts)
    found = {}
    for r in passages.repeated_passages(rows.drop("_d")).filter("kind = 'line'").collect():
        found.setdefault(r.class_id, set()).add(r.doc_id)
    assert sorted(found.values(), key=min) == [set(range(60 * k, 60 * k + 60)) for k in range(3)]


def test_wrapped_paragraphs(spark):
    """A paragraph wrapped into short lines is compared as a whole; a blank line ends it."""
    words = _words(60, 300)
    other = words[:20] + ["new"] + words[21:]
    own = [" ".join(_words(30, 310 + k)) for k in range(3)]

    def wrapped(w, n):
        return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))

    texts = {1: f"{own[0]}\n\n{wrapped(words, 11)}\n\n{own[1]}", 2: wrapped(other, 8), 3: own[2]}
    rows = passages.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    found = {r.doc_id: r for r in rows.filter("kind = 'line'").collect()}
    assert set(found) == {1, 2} and found[1].class_id == found[2].class_id
    assert texts[1][found[1].start : found[1].end] == wrapped(words, 11)
    assert texts[2][found[2].start : found[2].end] == texts[2]
    assert found[1].kept and not found[2].kept


def test_lines_equal_brute_force(spark, monkeypatch):
    """Linked lines of the given documents against all pairs of lines, blocks of a band kept small."""
    monkeypatch.setattr(passages, "BLOCK", 8)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {}
    for r in docs.collect():
        text = r.text or ""
        line, at = [], 0
        for m in re.finditer(r"[^ \t-\r]+", text):
            line.append((m.group().translate(LOWER), text.count("\n", 0, m.start())))
        ns = np.array([n for _, n in line], dtype=int)
        starts = passages.units_of(ns)[1]
        for a, b in zip(starts, np.append(starts[1:], len(line)), strict=True):
            if b - a >= 16:
                w = [x for x, _ in line[a:b]]
                sets.setdefault(tuple(w), [frozenset(zip(*[w[k:] for k in range(5)])), set()])[1].add(r.doc_id)
    units = list(sets.values())
    holders = {}
    for k, (s, _) in enumerate(units):
        for g in s:
            holders.setdefault(g, []).append(k)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(units[a][0] & units[b][0]) >= 75 * len(units[a][0] | units[b][0])]
    root = list(range(len(units)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        root[find(a)] = find(b)
    groups = {}
    for k in {k for pair in links for k in pair}:
        groups.setdefault(find(k), set()).update(units[k][1])
    want = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    got = {}
    for r in passages.repeated_passages(docs).filter("kind = 'line'").collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert want and sorted(sorted(g) for g in got.values()) == want


def test_line_dedup(docs):
    rows = _by_id(lines.dedup_lines(docs))
    # All shared lines go from the later document, to both ends of the run.
    assert rows[13].text == TEXTS[13] and rows[14].text == "new\nend"
    for i in (1, 2, 4, 5, 8, 9, 15):
        assert rows[i].text == TEXTS[i]
    assert rows[1].score == "clash" and lines.dedup_lines(docs).columns == docs.columns


def _deduped(texts: list[str]) -> list[str]:
    """Pairs of neighbouring content lines, the first occurrence of each stays."""
    seen, out = set(), []
    for text in texts:
        all_lines = text.split("\n")
        at = [i for i, x in enumerate(all_lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for i, j in zip(at, at[1:], strict=False):
            pair = (all_lines[i], all_lines[j])
            if pair in seen:
                gone.update((i, j))
            seen.add(pair)
        # Blank lines between two lines that go, go too.
        for i, j in zip(at, at[1:], strict=False):
            if i in gone and j in gone:
                gone.update(range(i, j))
        out.append("\n".join(x for i, x in enumerate(all_lines) if i not in gone))
    return out


def test_line_runs_go_whole(spark):
    """Runs of 2 to 40 lines planted in three documents each: every line of the later copies goes."""
    rng = random.Random(2)
    texts, planted = [], []
    for n in [2, 2, 2, 3, 3, 5, 5, 8, 12, 40]:
        run = [f"run {n} {rng.random()}" for _ in range(n)]
        run = [x for line in run for x in ([line, ""] if n == 8 else [line])]
        for _ in range(3):
            own = [f"own {rng.random()}" for _ in range(rng.randint(1, 6))]
            at = rng.randint(0, len(own))
            texts.append("\n".join([*own[:at], *run, *own[at:]]))
            planted.append((len(texts) - 1, own))
    texts += ["\n\n\n", "\n\n\n", " \n\t\n", "alone", "alone", "a\na\na\na", "x\r\ny\r\n", "z\nx\r\n \ny\r\n"]
    df = spark.createDataFrame([(i, t, i, t, t) for i, t in enumerate(texts)], "doc_id bigint, text string, row bigint, key string, cuts string")
    rows = _by_id(lines.dedup_lines(df))
    assert [rows[i].text for i in range(len(texts))] == _deduped(texts)
    assert all(rows[i].row == i and rows[i].key == rows[i].cuts == texts[i] for i in rows)
    for k, (i, own) in enumerate(planted):
        if k % 3:
            assert [x for x in rows[i].text.split("\n") if x] == own


def test_line_report_moves_texts_once(spark):
    """The plan is the same for small and large tables: no forced broadcast, one shuffle of texts for both looks at them."""
    texts = ["a\nb\nc", "x\na\nb", "y"]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = lines.line_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
        rows = _by_id(report)
        plan = report._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [(rows[i].n_cut, rows[i].cut) for i in range(3)] == [(0, ""), (2, "1:2"), (0, "")]
    assert "BroadcastHashJoin" not in plan
    assert len(re.findall(r"ReusedExchange \[key#\d+, text#\d+\]", plan)) == 1


def test_no_link_is_lost_in_a_large_group(spark, monkeypatch):
    """A large group of variants, and edited copies that are like one variant only: regions far above a block."""
    monkeypatch.setattr(forest, "BLOCK", 8)
    monkeypatch.setattr(forest, "WIDE", 16)
    rng = random.Random(7)
    base = _words(400, 70)
    texts = {}
    for k in range(600):
        own = base[:]
        for _ in range(3):
            own[rng.randrange(400)] = f"v{rng.randrange(10**9)}"
        texts[k] = own
    for k in range(60):
        own = texts[rng.randrange(600)][:]
        # Ten spread edits cost fifty shingles: about .76 to the variant, below .75 to every other one.
        for at in range(5, 400, 40):
            own[at] = f"e{rng.randrange(10**9)}"
        texts[600 + k] = own
    sets = {i: {tuple(w[a : a + 5]) for a in range(396)} for i, w in texts.items()}
    want = [i for i in range(600, 660) if any(100 * len(sets[i] & sets[k]) >= 75 * len(sets[i] | sets[k]) for k in range(600))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id bigint, text string")
    rows = _by_id(forest.near_dedup(df))
    assert all(rows[k].component_id == 0 for k in range(600))
    assert len(want) > 20 and [i for i in want if rows[i].component_id != 0] == []


def _base(t: str) -> str:
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    out = []
    for o, (kind, p) in enumerate(patterns):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            twice = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                "card": 12 <= len(d) <= 19 and twice % 10 == 0,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if good:
                out.append((m.start(), o, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, o, e, k in sorted(out))


def test_private_base(docs):
    rows = _by_id(private.private_report(docs))
    for i, t in TEXTS.items():
        if i != 9:
            assert rows[i].base_sha256 == hashlib.sha256(_base(t or "").encode()).hexdigest()
    assert rows[15].n_email == 2 and rows[15].n_card == 1


def _wilson(k, n, side, z=1.645):
    return (k + z * z / 2 + side * z * math.sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z)


def _telling(texts: dict) -> dict[str, int]:
    """Words and their level, by all pairs of entities and words of the distinct texts."""
    distinct = set(texts.values())
    held, stands = {}, {}
    for own in distinct:
        t = own
        spans = [x.split(":") for x in _base(t).split(",") if x]
        taken = [(int(a), int(b)) for _, a, b in spans]
        # The changed copies are one family.
        t = "copy" if "copycat" in t else t
        for kind, a, b in spans:
            value = own[int(a) : int(b)].lower()
            held.setdefault(re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value, set()).add(t)
            if kind == "email":
                held.setdefault("domain " + value.rsplit("@")[-1], set()).add(t)
        for m in WORD.finditer(own):
            stands.setdefault(m.group().lower(), set()).add(own)
            if not any(m.start() < b and a < m.end() for a, b in taken):
                stands.setdefault(("free", m.group().lower()), set()).add(t)
    n, out = len(distinct), {}
    for of in held.values():
        for w, where in stands.items():
            if isinstance(w, tuple) and len(of) >= 3 and len(where & of) >= 3 and len(of) < n:
                low = _wilson(len(where & of), len(of), -1) / _wilson(len(stands[w[1]]), n, 1)
                share = math.log(low) / math.log(n / len(of))
                if share >= 0.7:
                    out[w[1]] = max(out.get(w[1], 1), 2 if share >= 0.9 else 1)
    return out


def test_words_that_disclose(spark):
    """All pairs of entities and words by brute force; words that disclose are marked in every text, also without the value."""
    rng = random.Random(11)
    vocabulary = _words(3000, 30)

    def around(*parts: str) -> str:
        """The parts among random words."""
        return " ".join(" ".join([*rng.choices(vocabulary, k=12), part]) for part in parts) + " the end"

    plain = [(100 + k, around("the")) for k in range(400)]
    told = [(k, around("zanzibar", "ann@x.org")) for k in range(25)]
    told += [(30 + k, around("call +1 (555) 123-4567", "quorum")) for k in range(8)]
    told += [(40 + k, around(f"v{k}@pool.org", "swims")) for k in range(8)]
    told += [(50, around("bob@once.org", "hapax")), (51, around("Zanzibar", "quorum")), (52, told[0][1])]
    # Copies with a small change are no evidence: their words go with the value by nature.
    copy = around("copycat", "eve@twice.net", "copied")
    told += [(53, copy), (54, copy + " again"), (55, "so " + copy)]
    texts = dict(told + plain)
    rows = _by_id(private.private_report(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")))
    want = _telling(texts)
    assert want["zanzibar"] and want["quorum"] and want["swims"]
    assert not {"the", "end", "hapax", "copycat", "copied"} & set(want)
    for i, t in texts.items():
        base = [x for x in _base(t).split(",") if x]
        spans = [(int(a), int(b)) for _, a, b in (x.split(":") for x in base)]
        marks = [
            f"{('general', 'removed')[want[m.group().lower()] - 1]}:{m.start()}:{m.end()}"
            for m in WORD.finditer(t)
            if m.group().lower() in want and not any(m.start() < b and a < m.end() for a, b in spans)
        ]
        assert sorted(x for x in rows[i].spans.split(",") if x) == sorted(base + marks)
        assert rows[i].n_told == len(marks)
    assert rows[51].n_told == 2
    clean = _by_id(private.sanitise(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")))
    assert "zanzibar" not in clean[0].text and "[email]" in clean[0].text and "Zanzibar" not in clean[51].text
    assert all(clean[i].text == t for i, t in plain if not rows[i].n_told)


def test_words_that_disclose_stand_anywhere(spark):
    """A name in a letter's head and a room with digits in it are weighed with a number in its foot."""
    rng = random.Random(4)
    vocabulary = _words(2000, 13)

    def some(n: int) -> str:
        return " ".join(rng.choices(vocabulary, k=n))

    plain = [(100 + k, some(40)) for k in range(600)]
    letters = {k: f"zanzibar {some(150)} kx77-q {some(5)} +1 (555) 123-4567, {some(9)}" for k in range(8)}
    rows = _by_id(private.private_report(spark.createDataFrame([*letters.items(), *plain], "doc_id bigint, text string")))
    for i, letter in letters.items():
        for w in ("zanzibar", "kx77-q"):
            at = letter.index(w)
            assert re.search(rf"(general|removed):{at}:{at + len(w)}", rows[i].spans)
    assert all("zanzibar" not in t for _, t in plain)


def test_fingerprints(docs):
    rows = fingerprint.edited_pairs(docs).collect()
    assert len(rows) == len(ROWS)
    prints = {}
    for r in rows:
        prints.setdefault(TEXTS.get(r.doc_id, "null id text") or "", set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())
    got = {r.doc_id: r for r in rows}
    for i in (3, 6, 9, 12, 16):
        t, after = TEXTS[i] or "", TEXTS[i - 1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[3].near_next > 0.7


def test_fingerprint_estimates_generalised_jaccard(spark, docs):
    a, b = Counter(_words(200, 13)), Counter(_words(200, 13)[:120] + _words(80, 14))
    a["often"], b["often"] = 40, 10
    texts = [(1, " ".join(a.elements())), (2, " ".join(b.elements()))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = fingerprint.fingerprints(df, "text", ["doc_id"], 64)
    x, y = (np.array(r["_codes"]) for r in found.orderBy("doc_id").collect())
    true = sum(min(a[w], b[w]) for w in a | b) / sum(max(a[w], b[w]) for w in a | b)
    assert abs((x == y).mean() - true) < 0.2


def test_quality(spark, docs):
    good = [(k, " ".join(_words(80, 100 + k)).capitalize() + ".") for k in range(150)]
    bad = [(500 + k, " ".join(w + "###" for w in _words(80, 300 + k))) for k in range(60)]
    table = spark.createDataFrame(good + bad + [(900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame(
        [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (5, None, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    rows = _by_id(quality.classify(table, labels))
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in rows}
    assert all(rows[i].held_out == fold[i] for i in rows)
    assert all(rows[i].predicted == 1 for i, _ in good) and all(rows[i].predicted == 0 for i, _ in bad)
    assert rows[900].score == rows[901].score
    none = quality.classify(table, labels.limit(0)).select("score").distinct().collect()
    assert none == [Row(score=0.5)]


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    index, value = np.array([3, 8, 11, 40]), np.array([0.5, 1.0, 2.0, -1.0])
    want = 0.3 + m.linear[index] @ value
    for i in range(4):
        for j in range(i):
            want += m.factors[index[i]] @ m.factors[index[j]] * value[i] * value[j]
    assert abs(m.margins(index, value, np.array([0]))[0] - want) < 1e-9


@pytest.mark.parametrize(
    "run",
    [
        passages.repeated_passages, fingerprint.edited_pairs, private.private_report, forest.near_dedup,
        lambda d: tokens.count_tokens(d, PIECES), lambda d: packing.pack(d, BYTES), exact.exact_dedup,
        lines.line_report, lambda d: pieces.piece_digests(d, PIECES),
    ],
)
def test_empty_table(docs, run):
    assert run(docs.limit(0)).count() == 0
