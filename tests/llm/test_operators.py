"""Chat, BPE, token counts, WARC, SimHash, toxicity, decontamination and secrets: edge cases against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from kairos.llm import (op1_chat, op2_bpe, op3_token_counts, op4_warc, op6_simhash, op7_toxicity, op8_decontamination, op9_secrets, queries)

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


# --- 1 ------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\/s>", "[ANS] x </s>\n", "\\", "", None, "[ROLE] a\nb [/ROLE]\n", "<s", "[", "a $1 \\1 {x}",
             "x" * 200_000, " lead and trail ", "\n", "[INST\\]", "[\\INST]", "<s><s></s>"]
    roles = ["user", "assistant", "system", "tool", "a\nb\\n", None, "[ANS]"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(roles), rng.choice(nasty)) for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(50, 0, "user", "q"), (50, 1, "assistant", "a"), (51, 0, "assistant", "a"), (52, 0, "system", "s"), (52, 1, "user", "u"),
             (52, 2, "assistant", None), (53, 1, "user", "b"), (53, 1, "user", "b"), (None, None, "user", "n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = {r.conv_id: r for r in op1_chat.read_back(op1_chat.format_chats(df)).collect()}
    chats = {}
    for c, t, role, text in rows:
        chats.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert set(out) == set(chats)
    for c, turns in chats.items():
        turns.sort()
        assert [(x.role, x.text) for x in out[c].turns] == [x[1:] for x in turns]
        assert out[c].loss_text == "".join(x[2] for x in turns if x[1] == "assistant")
        assert out[c].formatted == "".join(s.text for s in out[c].segments) and out[c].n_turns == len(turns)
    assert [out[c].valid for c in (50, 51, 52, 53)] == [True, False, True, False]
    assert op1_chat.format_chats(df.limit(0)).count() == 0


# --- 2, 3 ---------------------------------------------------------------------------------------------------------

TEXTS = [(0, "hello  world's\n\n 123 　x"), (1, None), (2, ""), (3, "<|endoftext|> ok"), (4, "naïve café " * 3000), (5, "a" * 30_000),
         (5, "a" * 30_000), (None, "null id"), (7, "\x1c\x85\xa0  \U0001f600 ٠⅕"), (8, " ")]


def test_bpe_matches_the_library(spark, monkeypatch):
    monkeypatch.setattr(op2_bpe, "BLOCK_BYTES", 20_000)  # several blocks
    enc = op2_bpe.encoder(op2_bpe.read_ranks(RANKS), P.PATTERN)
    df = docs_of(spark, [(*r, 1) for r in TEXTS], ", ids int").repartition(3)
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.bytes)) for r in op2_bpe.decode(op2_bpe.encode(df, RANKS, P.PATTERN), RANKS).collect())
    assert got == Counter((d, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for d, t in TEXTS)
    assert op2_bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_bpe_of_nothing_but_empty_texts(spark):
    df = docs_of(spark, [(1, None), (2, ""), (3, "")])
    assert sorted((r.doc_id, list(r.ids)) for r in op2_bpe.encode(df, RANKS, P.PATTERN).collect()) == [(1, []), (2, []), (3, [])]
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r)[1:] for r in op2_bpe.digests(op2_bpe.encode(df, RANKS, P.PATTERN), RANKS).collect()} == {(0, empty, empty)}


def test_token_counts(spark):
    enc = op2_bpe.encoder(op2_bpe.read_ranks(RANKS), P.PATTERN)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(docs_of(spark, TEXTS))
    lengths = [len(enc.encode_ordinary(r.text or "")) for r in docs.collect()]
    sums = op3_token_counts.suffix_sums(op3_token_counts.histogram(docs, RANKS, P.PATTERN))
    rows = sums.collect()
    assert {r.length: r.n_docs for r in rows} == Counter(lengths)
    for r in rows:
        at = [x for x in lengths if x >= r.length]
        assert (r.docs_from, r.tokens_from, r.total_cut) == (len(at), sum(at), sum(min(x, r.length) for x in lengths))
        assert r.quantile == pytest.approx(sum(x <= r.length for x in lengths) / len(lengths))
    limits = [0, 1, 100, 333, 4096, 10**6]
    got = {r.context: (r.docs_from, r.total_cut) for r in op3_token_counts.at_limits(sums, limits).collect()}
    assert got == {c: (sum(x >= c for x in lengths), sum(min(x, c) for x in lengths)) for c in limits}
    assert op3_token_counts.suffix_sums(op3_token_counts.histogram(docs.limit(0), RANKS, P.PATTERN)).count() == 0


# --- 4 ------------------------------------------------------------------------------------------------------------


def test_warc_round_trip_and_lookups(spark):
    big, wide = "x" * 1000, "é" * 5000
    rows = [(k, f"http://www{k % 2 or ''}.Host{k % 3}.example.org:80/p/{k % 7}?q={k}#f", f"page {k} " * (k % 50)) for k in range(300)]
    rows += [(1000 + k, "https://hot.example.com/same", big) for k in range(100)] + [(2000, None, wide), (2001, "::bad url [", wide),
             (2002, "http://a/ b\n", None), (2003, "", ""), (None, "http://n.example/", big), (2004, "http://n.example/", "y" * 999),
             (2005, "http://n.example/", "y" * 999), (2006, "http://dup/", wide), (2006, "http://dup/", wide)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string").repartition(4)
    index = op4_warc.archive(df.select("page_id", "url", "html"))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in op4_warc.lookup(df.select("url", "page_id"), index).collect())
    largest = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            largest[h] = max(largest.get(h, i), i)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        to = largest.get(h) if i is not None and largest.get(h) != i else None
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to)] += 1
    assert got == want
    by_url = op4_warc.lookup(spark.createDataFrame([("http://HOT.example.com:443/same",), ("http://none/",)], "url string"), index)
    found = by_url.collect()
    assert sorted(r.page_id for r in found) == list(range(1000, 1100))
    assert [bytes(r.payload) for r in found if r.record_type == "response"] == [big.encode()]
    assert op4_warc.lookup(df.limit(0).select("url", "page_id"), op4_warc.archive(df.limit(0))).count() == 0


def test_url_keys():
    assert op4_warc.url_key("http://www.Blog.Example.org:80/a?b=c#d") == "org,example,blog)/a?b=c"
    assert op4_warc.url_key("https://x.y:8443") == "y,x:8443)/" and op4_warc.url_key(None) == ")/"


# --- 6 ------------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits=2):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    order = sorted(prints)
    for i, x in enumerate(order):
        for y in order[:i]:
            if (x ^ y).bit_count() <= bits:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def test_simhash_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "ÉA one"), (9005, "two\x1cthree\x85four five"), (None, rows[0][1]), (9007, rows[0][1]),
             (9007, rows[0][1]), (9008, "w " * 50_000)]
    df = docs_of(spark, [(*r, 5) for r in rows], ", fp int")
    got = op6_simhash.near_duplicates(df).withColumn("hex", op6_simhash.hex16("fp")).collect()
    prints = {t: brute_print(t) for _, t in rows}
    roots = brute_components(set(prints.values()))
    low = {}
    for d, t in rows:
        if d is not None:
            r = roots[prints[t]]
            low[r] = min(low.get(r, d), d)
    want = Counter((d, f"{prints[t]:016x}", low.get(roots[prints[t]])) for d, t in rows)
    assert Counter((r.doc_id, r.hex, r.component_id) for r in got) == want
    kept = [r.doc_id for r in op6_simhash.deduplicate(df).collect()]
    assert Counter(kept) == Counter(d for d, t in rows if d is None or d == low[roots[prints[t]]])
    assert op6_simhash.near_duplicates(df.limit(0)).count() == 0


PLANS = {"chosen": None, "halves": [(range(32), 0), (range(32, 64), 1)], "one": [(range(32), 2)], "quarters": [(range(k, k + 16), 0) for k in (0, 16, 32)]}


@pytest.mark.parametrize("crowd, plan", [(1000, "chosen"), (4, "chosen"), (4, "halves"), (1000, "halves"), (1000, "one"), (1000, "quarters")])
def test_links_of_random_fingerprints(spark, monkeypatch, crowd, plan):
    """Chains and clumps of fingerprints: every allocation of thresholds, and crowded buckets, link the same components."""
    if PLANS[plan]:
        monkeypatch.setattr(op6_simhash, "choose_plan", lambda *_: [(list(bits), t) for bits, t in PLANS[plan]])
    rng, prints = random.Random(5), set()
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(12):
            prints.add(p)
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    roots = {r.node: r.root for r in op6_simhash.components(op6_simhash.links(df, crowd=crowd)).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(roots.get(signed(p), signed(p)), set()).add(p)
    want = {}
    for p, r in brute_components(prints).items():
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_links_within_other_distances(spark, bits):
    """Crowded and calm buckets link the same components for any distance, also odd ones."""
    rng, prints = random.Random(9), set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(15):
            prints.add(p)
            q = p
            for _ in range(rng.randint(1, 4)):
                q ^= 1 << rng.randrange(64)
            p = q
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    roots = {r.node: r.root for r in op6_simhash.components(op6_simhash.links(df, bits, crowd=4)).collect()}
    groups, want = {}, {}
    for p in prints:
        groups.setdefault(roots.get(signed(p), signed(p)), set()).add(p)
    for p, r in brute_components(prints, bits).items():
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_threshold_allocation():
    costs = [[0, 5, 50, 500], [0, 1, 2, 900], [0, 7, 9, 11]]
    best, chosen = op6_simhash.allocate(costs, 0)
    every = [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0]
    assert best == min(sum(costs[i][t + 1] for i, t in enumerate(x)) for x in every) and tuple(chosen) in every


# --- 7 ------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_never_sees_held_out_labels(spark):
    rng = random.Random(1)
    words = ["haus", "baum", "river", "stone", "cloud", "paper", "green", "monde", "libro", "calle"]
    rows, labels = [], []
    for d in range(1200):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = d % 6 == 0
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["vileword", "vilewords", "nastyish"]))
        rows.append((d, " ".join(text)))
        labels.append((d, int(bad)))
    df, lab = docs_of(spark, [(*r, 1.0) for r in rows], ", score double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = op7_toxicity.train(df, lab, where=~op7_toxicity.held_out())
    got = {r.doc_id: r.score for r in op7_toxicity.scored(df, model).collect()}
    held = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    right = sum((got[d] >= op7_toxicity.THRESHOLD) == (d % 6 == 0) for d in held)
    assert len(held) > 200 and right / len(held) > 0.97
    flipped = lab.withColumn("toxic", F.when(op7_toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = op7_toxicity.train(df, flipped, where=~op7_toxicity.held_out())
    assert again[1] == model[1] and (again[0] == model[0]).all()
    odd = docs_of(spark, [(1, None), (2, ""), (None, "x"), (3, "ab " * 400_000), (4, "same"), (4, "same")])
    scores = op7_toxicity.scored(odd, model).collect()
    assert len(scores) == 6 and all(0 <= r.score <= 1 for r in scores)
    none = op7_toxicity.train(df.limit(0), lab.limit(0))
    assert all(r.score == 0.5 for r in op7_toxicity.scored(odd, none).collect())


# --- 8 ------------------------------------------------------------------------------------------------------------


def brute_contamination(docs, items, window=13):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (got := wins.get(tuple(w[k:k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= got
        out.append((d, len(w), len(hit), tuple(sorted(str(i) for i in found if i is not None))))
    return Counter(out)


@pytest.mark.parametrize("max_words", [op8_decontamination.BLOCK_WORDS, 40])
def test_contamination(spark, max_words):
    rng = random.Random(2)
    vocab = ["a", "b", "ÄÖ", "x1", "don", "t"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.choice([3, 5, 13, 14, 30]))) for k in range(12)] + [(99, None), (98, "--- !!"), (3, text(20)), (None, text(15)), (97, "solo")]
    docs = [(k, ", ".join([text(40), rng.choice(items)[1] or "", text(rng.randint(0, 60))])) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "..."), (103, "SOLO-solo"), (103, "SOLO-solo"), (None, items[4][1]), (104, (items[3][1] + " zz ") * 500)]
    df = docs_of(spark, [(*r, 0) for r in docs], ", n_words int").repartition(3)
    got = op8_decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string"), max_words=max_words).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == brute_contamination(docs, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in op8_decontamination.contamination(df, none).collect())
    assert op8_decontamination.contamination(df.limit(0), none).count() == 0
    assert op8_decontamination.decontaminate(df, none).columns == df.columns


def test_longest_match_and_place(spark):
    item = " ".join(f"w{k}" for k in range(40))
    doc = "before it " + " ".join(f"w{k}" for k in range(5, 30)) + " after"
    row = op8_decontamination.contamination(docs_of(spark, [(1, doc)]), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert [tuple(m) for m in row.matches] == [(7, 5, 2, 25)] and [tuple(s) for s in row.spans] == [(2, 27)]


# --- 9 ------------------------------------------------------------------------------------------------------------


def brute_secrets(t):
    t = t or ""
    out = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for at, (kind, pattern, ok) in enumerate([("assign", assign, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
                                              ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]):
        out += [(m.start(), at, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(t) if ok(m)]
    return [x[2] for x in sorted(out)]


def test_secrets(spark):
    hexes, key = "0123456789abcdef" * 2, "AKIA" + "Q7" * 8
    texts = ["", None, f"é token = '{hexes}' {key}", "secret:token: abcdefgh", "PassWord=\"abc\" passwd=abcdef api_key: x/y+z=_-.", key + "\n" + key + "AKIA",
             "\U0001f600" * 5 + hexes + "g" + hexes, "AKIAAKIA" + "B" * 12, "token=abcde token=abcdef", "a" * 100_000, "ſecret=abcdefgh toKen=abcdefgh",
             "ghp_" + "aB3dE5" * 6, "x " * 50_000 + "password=longtail1"]
    rows = [(k, t, "own" if k % 2 else None, None) for k, t in enumerate(texts)] + [(2, texts[2], "other", "en")] * 2
    rows += [(500 + k, "-- ghp_" + "zY9xW8" * 6, f"owner{k}", "en") for k in range(10)] + [(None, texts[5], "q", "q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lang string, row int")
    got = op9_secrets.scan(df).withColumn("base", op9_secrets.of_kinds(op9_secrets.BASE)).collect()
    assert Counter((r.doc_id, tuple(f"{s.kind}:{s.start}:{s.end}" for s in r.base)) for r in got) == Counter(
        (d, tuple(brute_secrets(t))) for d, t, *_ in rows)
    forged = {r.doc_id: [s for s in r.spans if s.kind == "forge"] for r in got}
    assert len(forged[11]) == 1 and forged[11][0].live and not forged[505]  # ten owners: an example
    assert op9_secrets.scan(df.limit(0)).count() == 0


def brute_keys(text):
    """Private keys of a text as (start, end, value), found without regular expressions over the body."""
    out, at = [], 0
    for m in re.finditer(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", text):
        end = re.search(r"-----END [A-Z ]*PRIVATE KEY-----", text[m.end():])
        if m.start() < at or not end or "-----BEGIN" in text[m.end():m.end() + end.start()]:
            continue
        lines = re.split(r"\n|\r|\\n|\\r", text[m.end():m.end() + end.start()])
        body = "".join(x for x in lines if ":" not in x).replace(" ", "").replace("\t", "")
        if len(body) >= 64 and re.fullmatch("[A-Za-z0-9+/=]*", body):
            at = m.end() + end.end()
            out.append((m.start(), at, body))
    return out


def test_private_keys_are_owned_one_by_one(spark, tmp_path):
    """Keys of many owners stay live, one key of many owners (however its lines end) is an example, and marks in prose are no key."""
    def key(k, head="", end="\n"):
        body = end.join(hashlib.sha256(f"{k}/{i}".encode()).hexdigest().upper() + "+/" for i in range(3))
        return f"-----BEGIN RSA PRIVATE KEY-----{end}{head}{body}=={end}-----END RSA PRIVATE KEY-----"
    crypt = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    many = "".join(f"Header-{k}: value {k}\n" for k in range(30)) + "\n"
    texts = [f"mine: {key(k)} here" for k in range(5)] + [key(10 + k, crypt) for k in range(4)] + [key(20 + k, end="\\n") for k in range(4)]
    texts += [key(20 + k, crypt.replace("\n", "\\n"), "\\n") for k in range(10, 14)] + [key(60, many)]
    rows = [(k, t, f"owner{k}", "en") for k, t in enumerate(texts)]
    # one key in four styles of line ends, each with an owner of its own, and with header lines
    styles = [key(99), key(99, end="\r\n"), key(99, end="\\n"), key(99, end=""), key(99, crypt)]
    rows += [(100 + k, t, f"style{k}", "en") for k, t in enumerate(styles)]
    # few owners, many repositories
    rows += [(150 + k, key(98), f"owner{k % 2}", f"lang{k}") for k in range(6)]
    prose = ["-----BEGIN RSA PRIVATE KEY-----\n-----END RSA PRIVATE KEY-----", "see -----BEGIN RSA PRIVATE KEY----- as the first line",
             "-----BEGIN PRIVATE KEY----- and then it ends with -----END PRIVATE KEY-----", key(70).replace("-----END RSA PRIVATE KEY-----", ""),
             "-----BEGIN PRIVATE KEY-----\n" + "A: b\n" * 20_000 + "AAAA" * 30]
    rows += [(200 + k, t, f"prose{k}", "en") for k, t in enumerate(prose)] + [(300, key(61) + " and " + key(62) + "\n" + "Q" * 200_000, "two", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op9_secret_scan"](spark, str(tmp_path)).collect()
    found = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("key:")] for r in got}
    owners, repositories = {}, {}
    for _, t, source, lang in rows:
        for *_, body in brute_keys(t):
            owners.setdefault(body, set()).add(source)
            repositories.setdefault(body, set()).add((source, lang))
    live = lambda body: len(owners[body]) <= 2 and len(repositories[body]) <= 4
    assert found == {d: [(s, e) for s, e, body in brute_keys(t) if live(body)] for d, t, *_ in rows}
    assert sum(map(len, found.values())) == len(texts) + 2 and not any(found[d] for d in found if 100 <= d < 300)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLE["op9_secret_scan"])
    assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall())


def test_registry_has_every_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_repetitive_texts_stay_small(spark):
    """One word repeated in a document and in an item: the places are the words, not their product."""
    import resource

    from kairos.llm.common import NON_ALNUM, WordHasher, byte_map, word_spans
    import numpy as np
    import pyarrow as pa
    text = ("so " * 20_000 + "\n").encode()
    lut, hasher = byte_map(NON_ALNUM), WordHasher()
    mapped = lut[np.frombuffer(("so " * 4_000).encode() + b"\n", np.uint8)]
    words = hasher(mapped, *word_spans(mapped))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text], pa.binary())], ["doc_id", "text"])
    shard = op8_decontamination._Shard(batch, hasher, lut, 13)
    shard.search(words, np.array([0, len(words)]), [7], 13)
    assert shard.spans() == [[{"s": 0, "e": 20_000}]] and shard.item_ids() == [[7]]
    assert shard.matches()[0] and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def thue_morse(order):
    a = "a"
    for _ in range(order):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_structured_words_never_meet_by_hash(spark):
    """Thue-Morse words and lines, whose polynomial hashes agree modulo 2^64, are different words and lines."""
    from kairos.llm import op5_quality, op10_line_dedup
    a, b = thue_morse(11)
    lines = spark.createDataFrame([(1, f"{a}\n{b}\n{a} x\n{b} x\n{a}"), (2, f"{b} y\n{b}")], "doc_id long, text string")
    gone, _ = op10_line_dedup.removed_lines(lines)
    assert {(r.doc_id, r.line): (r.match_doc, r.match_line) for r in gone.collect()} == {(1, 4): (1, 0), (2, 1): (1, 1)}
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    base = {r.doc_id: (r.n_words, r.n_dup_lines) for r in op5_quality.rules(lines, op5_quality.train(lines, labels)).collect()}
    assert base == {1: (7, 1), 2: (3, 0)}
    items = spark.createDataFrame([(5, a)], "item_id long, text string")
    hit = {r.doc_id: r.n_hit for r in op8_decontamination.contamination(lines, items).collect()}
    assert hit == {1: 3, 2: 0}


def test_clashing_column_names(spark):
    """Functions that return the documents give back every column as it was, whatever its name."""
    from kairos.llm import op10_line_dedup
    text = "some words that stand in this document and in no other one"
    names = ["_gone", "_doc", "gone", "doc", "gone_id", "_gone_id", "bad_id", "_bad_id", "toxicity", "_toxicity", "a.b", "line"]
    rows = [(k, text if k < 2 else f"{text} {k} " * k, *names) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(0, 0), (3, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "nothing of this")], "item_id long, text string")
    for out in (op10_line_dedup.dedup_lines(df), op6_simhash.deduplicate(df), op8_decontamination.decontaminate(df, items), op7_toxicity.keep_clean(df, labels)):
        assert out.columns == df.columns and {tuple(r)[2:] for r in out.collect()} == {tuple(names)}
