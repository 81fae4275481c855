"""The corpus operators against the libraries, brute force and round trips, with nulls, empty and long texts, ties and odd columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from haggle.llm import byte_pairs, components, contamination, exact, near, pages, passages, pretokens, queries, secrets, token_counts, token_files, toxicity

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, keep_id string, h string, row string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = [None, "", " ", "\n\n", "it's we'll they've 'tis I'D", "a<|endoftext|>b", "naïve  ÄÖ x y 中文 12³ ½!", "x" * 5000, "Zu und. " * 3000, "\U0001f600 'S"]
    words = ["alpha", "Beta", "gamma", "delta", "ÉTÉ", "don't", "x1", "...", "(yes)", "\tend\n", "zeta", "eta", "theta", "iota", "kappa"]
    made += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return made + made[20:30] + [made[30] + " more", made[31] + " more"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "xx", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- tokens


def test_split_is_the_librarys(texts):
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    rng = random.Random(1)
    cases = [t for t in texts if t] + ["".join(rng.choice("abst mdrevl'  \n\tÄ9!. é'") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    cases.append("".join("A" + chr(c) + "\n" for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000))
    for t in cases:
        data = np.frombuffer(t.encode(), np.uint8)
        tokens, _ = pretokens.split(data, np.array([0, len(data)]))
        assert [b.decode() for b in tokens.to_pylist()] == [t[a:b] for _, (a, b) in split.pre_tokenize_str(t)]


def test_packing_round_trip():
    for values in ([], [0], [255, 256, 65535, 65536, 2**24, 2**32 - 1, 7], list(range(1000))):
        control, data = token_files.pack(np.array(values, np.uint32))
        assert token_files.unpack(control, data, len(values)).tolist() == values


def test_token_files(docs, texts, none, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    got = by_id(token_files.read_tokens(spark, token_files.write_tokens(docs, JSON, end_id=2)))
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], bytes(got[i]["ids"])) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    assert token_files.read_tokens(spark, token_files.write_tokens(none, JSON)).count() == 0


def test_token_counts(docs, texts, none, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    for head in (token_counts.HEAD, 3):  # nearly all from the table, and nearly all where they stand
        monkeypatch.setattr(token_counts, "HEAD", head)
        got = by_id(token_counts.count_tokens(docs, JSON))
        for i, t in enumerate(texts):
            assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
    assert token_counts.count_tokens(none, JSON).count() == 0


def test_perfect_hash_and_merges():
    import tiktoken

    ranks = byte_pairs.read_ranks(RANKS)
    table = byte_pairs.PerfectHash.build(ranks)
    words = list(ranks)[::37] + [b"qqqq", b"\xff\xfe", b"zzzzzzzzzz"]
    ends = np.cumsum([len(w) for w in words])
    found = table.find(np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], ends[:-1])), ends)
    assert found.tolist() == [ranks.get(w, -1) for w in words]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(500):
        w = "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 30)))
        assert byte_pairs.merge(w.encode(), ranks) == library.encode_ordinary(w)


def test_byte_pairs(docs, texts, none):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(RANKS), special_tokens={})
    got = by_id(byte_pairs.decode(byte_pairs.encode(docs, RANKS), RANKS))
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == library.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode()
    assert byte_pairs.decode(byte_pairs.encode(none, RANKS), RANKS).count() == 0


# ---- duplicates


def test_exact(docs, texts, none, spark):
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for capacity in (exact.CAPACITY, 200):  # one bucket, and a directory that doubles often
        got = by_id(exact.exact_duplicates(docs, capacity=capacity))
        for t, ids in groups.items():
            for i in ids:
                assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    kept = exact.keep_one(docs.unionByName(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert exact.exact_duplicates(none).count() == 0 and exact.keep_one(none).count() == 0
    odd = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b")], "doc_id bigint, text string")
    assert sorted((r["keep_id"] or 0, r["kept"]) for r in exact.exact_duplicates(odd).collect()) == [(0, True), (3, False), (3, True)]


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def least_links(sets, low, high):
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and high * len(sets[i] & sets[j]) >= low * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def test_sketch_holds_little_beside_the_texts():
    """Memory of the hashing task stands by its slices, not by its batch; slices change no signature."""
    import tracemalloc

    rng = random.Random(8)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(80)), "text": [" ".join(str(rng.randrange(10**6)) for _ in range(15_000)) for _ in range(80)]})
    tracemalloc.start()
    whole = pa.Table.from_batches(near._sketch(5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    single = pa.Table.from_batches([x for i in range(80) for x in near._sketch(5)(iter([batch.slice(i, 1)]))])
    assert whole.to_pydict() == single.to_pydict()
    print(f"peak {peak / 1e6:.0f} MB of a batch of {batch.nbytes / 1e6:.0f} MB")
    assert peak < 120e6


def test_near(docs, texts, none, spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    made = list(texts)
    for k in range(40):  # a group of near copies with links, and with pairs just below
        copy = list(base)
        for _ in range(k % 9):
            copy[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        made.append(" ".join(copy))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id bigint, text string").repartition(4)
    for size, low in ((3, 85), (5, 80)):
        want = least_links({i: shingles(t, size) for i, t in enumerate(made)}, low, 100)
        got = by_id(near.near_components(rows, size, low, 100))
        assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in got} == {i: (len(shingles(t, size)), want[i]) for i, t in enumerate(made)}
    monkeypatch.setattr(near, "BLOCK", 5)  # many blocks in each key and cluster
    monkeypatch.setattr(near, "BLOCK_BYTES", 3000)
    assert {i: r["component_id"] for i, r in by_id(near.near_components(rows, 5, 80, 100)).items()} == want
    # rows that share an id are one vertex; a null id has no component
    one, two = "a b c d e f g h", "i j k l m n o p"
    shared = spark.createDataFrame([(1, one), (5, one), (5, two), (9, two), (None, one), (7, None)], "doc_id bigint, text string")
    got = near.near_components(shared, 5, 80, 100).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1), (5, 1), (5, 1), (9, 1), (None, None), (7, 7)], key=str)
    kept = near.keep_first(docs, 3, 85, 100)
    assert kept.columns == docs.columns
    assert near.near_components(none).count() == 0 and near.keep_first(none).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (5, 6)]
    got = {r["v"]: r["component"] for r in components.components(spark.createDataFrame(path, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_passages(spark, none):
    rng = random.Random(4)
    sentence = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(n) for n in (12, 15, 9, 20, 11))
    own = [" ".join(sentence(12) for _ in range(6)) for _ in range(30)]
    made = {i: t for i, t in enumerate(own)}
    for i in (3, 11, 19):
        w = made[i].split()
        made[i] = " ".join([*w[:10], passage, *w[10:]])
    made |= {40: None, 41: "", 42: "short."}
    rows = spark.createDataFrame(list(made.items()), "doc_id bigint, text string").repartition(3)
    got = passages.repeated_passages(rows).collect()
    assert {r["doc_id"] for r in got} == {11, 19} and {k for r in got for k in r["keep_ids"]} == {3}
    for r in got:
        assert made[r["doc_id"]].encode()[r["start"] : r["end"]].decode() in passage + " "
    cut = by_id(passages.without(rows, passages.repeated_passages(rows)))
    assert cut[3]["text"] == made[3] and cut[40]["text"] is None and len(cut[11]["text"]) < len(made[11]) - 200
    assert passages.repeated_passages(none).count() == 0


def test_passage_links(spark, monkeypatch):
    """Pairs that meet under a key whose first group is like neither of them; also over many small blocks."""
    rng = random.Random(12)
    word = lambda: f"u{rng.randrange(10**6)}"
    lines = []
    for _ in range(60):
        one = [word() for _ in range(60)]
        hub = [word() if k % 5 == 4 else w for k, w in enumerate(one)]
        pair = [one, [word() if k == 30 else w for k, w in enumerate(one)]]
        lines += [" ".join(x) for x in (hub, *pair)]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(3)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, lines)]
    alike = {(i, k) for i in range(len(sets)) for k in range(i) if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])}
    assert len(alike) == 60
    # runs of 40 words are none of the equal pieces
    for block in (near.BLOCK, 2):
        monkeypatch.setattr(near, "BLOCK", block)
        monkeypatch.setattr(near, "BLOCK_BYTES", 16 << 20 if block > 2 else 500)
        got = {(r["doc_id"], k) for r in passages.repeated_passages(rows, run_words=40).collect() for k in r["keep_ids"]}
        assert got <= alike and len(got) >= 0.95 * len(alike)

    def one_key(count, rows):
        def run(batches):
            for _, p in passages._each(batches):
                yield pa.RecordBatch.from_arrays([pa.array([7] * len(p.h1), pa.int64()), pa.array(p.h1.view(np.int64))], ["key", "h1"])

        return run

    monkeypatch.setattr(passages, "_band_keys", one_key)
    assert {(r["doc_id"], k) for r in passages.repeated_passages(rows, run_words=40).collect() for k in r["keep_ids"]} == alike


def test_passages_inside_sentences(spark):
    """Passages without an end of a sentence, or with two long ones, in the middle of others' sentences."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    made, planted = {}, []
    for i in range(0, 120, 2):
        passage = words(60)
        if i % 4 == 0:
            passage[29] += "."
        planted.append(" ".join(passage))
        for k in (i, i + 1):
            made[k] = " ".join([*words(30 + rng.randrange(9)), *passage, *words(30 + rng.randrange(9))])
    rows = spark.createDataFrame(list(made.items()), "doc_id bigint, text string").repartition(3)
    got = by_id(passages.repeated_passages(rows))
    assert set(got) <= set(range(1, 120, 2)) and len(got) >= 57 and all(r["keep_ids"] == [i - 1] for i, r in got.items())
    for i, r in got.items():
        cut = made[i].encode()[r["start"] : r["end"]].decode()
        assert cut in planted[i // 2] and r["n_words"] == len(cut.split())
    assert sum(r["n_words"] for r in got.values()) >= 0.6 * 60 * 60


def test_sentence_ends():
    rest = "one two three four five six seven eight nine"
    for end in ('."', ".)", ".\u201d", "?')", "!\u00bb"):
        text = f"{rest}{end} {rest} ten.".encode()
        p = passages.Paragraphs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert text[p.start[0] : p.end[0]].decode() == rest + end and len(p.head) == 2


# ---- benchmark passages, toxicity, pages, secrets


def test_contamination(docs, spark, none):
    items = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (3, None), (4, "!!"), (5, "a b c d e f g h i j"), (6, "b c d e f g h i j k")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    made = {1: "x ONE, two three four five six seven eight nine ten eleven y", 2: "short ITEM. shorter item", 3: None, 4: "a b c d e f g h i j k é", 5: "", 6: "two three"}
    rows = spark.createDataFrame(list(made.items()), "doc_id bigint, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for limit in (contamination.AUTOMATON_BYTES, 20):  # one automaton, and several
        got = by_id(contamination.find_passages(rows, bench, automaton_bytes=limit))
        for i, t in made.items():
            w, hit, ids = word.findall((t or "").translate(LOWER)), set(), set()
            for item, text in items:
                v = word.findall((text or "").translate(LOWER))
                n = min(len(v), 10)
                for a in range(len(v) - n + 1 if v else 0):
                    for b in range(len(w) - n + 1):
                        if w[b : b + n] == v[a : a + n]:
                            hit |= set(range(b, b + n))
                            ids.add(str(item))
            assert (got[i]["n_words"], list(got[i]["hits"]), list(got[i]["item_ids"])) == (len(w), sorted(hit), sorted(ids))
    span = by_id(contamination.find_passages(rows, bench))[1]["spans"][0]
    assert made[1].encode()[span["start"] : span["end"]] == b"ONE, two three four five six seven eight nine ten eleven"
    assert contamination.find_passages(none, bench).count() == 0
    assert contamination.keep_clean(docs, bench.limit(0)).count() == docs.count()
    assert sorted(r["doc_id"] for r in contamination.keep_clean(rows, bench).collect()) == [3, 5, 6]


def test_restoring():
    text = "the idiot and a clown are worthless trash " * 50
    coded = np.concatenate(([0, 0], toxicity.symbols(text), [0, 0])).astype(np.int64)
    counts = np.bincount((coded[:-2] * toxicity.SYMBOLS + coded[1:-1]) * toxicity.SYMBOLS + coded[2:], minlength=toxicity.SYMBOLS**3)
    model = toxicity.CharacterModel.of_counts(counts)
    for written, meant in (("1d1ot", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("cl0wn", "clown"), ("tr@sh", "trash"), ("idiiiiot", "idiot")):
        assert meant in toxicity.restore(f"see {written} here", model)
    assert toxicity.restore("plain words, 3 of them! (really)", model) == "plain words, 3 of them! (really)"


def test_suspects():
    """Disguised words after quotes, brackets and hyphens, signs at the end, and a filter that misses none of them."""
    spans = lambda text: [m.group() for m in toxicity._SUSPECT.finditer(text)]
    for text, span in (('"1d1ot"', "1d1ot"), ("(cl0wn),", "cl0wn"), ("you-l0ser", "l0ser"), ("*tr@sh*", "tr@sh"), ("an a$$ it is", "a$$"), ("cl0wn!", "cl0wn"), ("£oser", "£oser"), ("trick€", "trick€")):
        assert spans(text) == [span], text
    assert not spans("plain words, 3 of them! (really) wow!! £5 and 20 €")
    rng = random.Random(31)
    signs = [*"abIi01!$@|+€£ .-_*,/\"(", "é", "É", "ß", "ж", "Р", "р", "ẞ", "中", "𝐚"]
    for _ in range(20_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 9)))
        text = rng.choice(["", "# "]) + text + rng.choice(["", " # # # # # # # #"])
        if spans(text):
            assert len(toxicity._hits(np.frombuffer(text.encode(), np.uint8))), text


def test_toxicity(spark, none):
    rng = random.Random(6)
    clean = ["river", "stone", "garden", "window", "paper", "summer", "winter", "market"]
    made = {}
    for i in range(400):
        w = [rng.choice(clean) + rng.choice(["", "er", "ing", "ly"]) for _ in range(40)]
        if i % 4 == 0:
            w[rng.randrange(40)] = "vermin" + rng.choice(["", "ous", "ly"])
        made[i] = " ".join(w)
    rows = spark.createDataFrame([(i, t) for i, t in made.items()] + [(900, None), (901, ""), (902, "a v 3 r m 1 n ous VERM1N thing")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(rows, labels.where(~toxicity.held_out()))
    got = by_id(toxicity.score(rows, model))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all((got[i]["score"] >= 0.7) == (i % 4 == 0) for i in held)
    assert got[900]["score"] == got[901]["score"] < 0.7 <= got[902]["score"]
    assert {r["doc_id"] for r in toxicity.reject(rows, model).collect()} == {i for i in got if got[i]["score"] < 0.7}
    assert toxicity.score(none, model).count() == 0
    assert 0 <= by_id(toxicity.score(rows, toxicity.fit(rows, labels.limit(0))))[0]["score"] < 0.7


def test_pages(spark):
    shell = "<nav><ul><li>Home<li>News</ul></nav>{}<footer>&copy; all rights of this site are reserved here</footer>"
    plain = shell.format("<div>Read our daily letter for all the news</div><p>Own words of page {0} and <b>nothing</b>\n else<p>second {0}")
    rows = [
        (1, "http://a.example/1", shell.format("<article><h1>T&amp;t</h1><p>One <b>bold<br>x<p>two</p><aside>no</aside><div class='comments'>no</div></article>")),
        (2, "http://b.example/1", plain.format(1)), (3, "http://b.example/2", plain.format(2)), (4, None, None), (5, "http://[bad", ""), (6, "http://c.example", "just text &lt;3"),
    ]
    got = by_id(pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)), "page_id")
    assert got[1]["text"] == "T&t\nOne bold x\ntwo"
    assert got[2]["text"] == "Own words of page 1 and nothing else\nsecond 1" and got[3]["text"].endswith("second 2")
    assert (got[4]["text"], got[5]["text"], got[6]["text"]) == ("", "", "just text <3")
    assert pages.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_secrets(spark, none):
    rng = random.Random(8)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f'some plain words token = "{key(40)}" and more words' for _ in range(60)] + [f"a line password={key(18)} goes on" for _ in range(60)]
    texts += ["internationalization of responsibilities unquestionably" for _ in range(40)] + ["see path/to/some/long/folder/name here" for _ in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id bigint, text string")
    got = secrets.scan(rows).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == set(range(120))
    assert secrets.scan(none).count() == 0


def test_secret_candidates(spark):
    one, two = "0123456789abcdef0123", "fedcba9876543210ffff"
    rows = [
        (1, f'see {{"a":"{one}","b":"{two}"}} here', {("a", one), ("b", two)}), (2, f"api_key={one}&state=xyz12345", {("api_key", one)}),
        (3, "use password=hun!ter#2 now", {("password", "hun!ter#2")}), (4, 'db_password: "a$b%c&d1" end', {("db_password", "a$b%c&d1")}),
        (5, f"{one},{two}", {("", one), ("", two)}), (6, "plain words of no note", set()), (7, "token = x9!y8 and", {("token", "x9!y8")}),
    ]
    found = secrets.candidates(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")).collect()
    for i, _, want in rows:
        assert {(r["name"], r["secret"]) for r in found if r["doc_id"] == i} == want, i


# ---- queries


def test_queries_run(spark):
    from conftest import SF

    for name, build in queries.QUERIES.items():
        assert build(spark, SF).columns, name


def test_pipeline(spark):
    from conftest import SF

    import corpus_pipeline
    from haggle.sources.tables import table

    docs = table(spark, SF, "documents")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, steps[-1], SF).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= steps[-1].count(), name
        steps.append(kept)
    ids = [{r["doc_id"]: r["text"] for r in s.select("doc_id", "text").collect()} for s in steps]
    groups = collections.defaultdict(list)
    for i, t in ids[1].items():
        groups[t or ""].append(i)
    assert set(ids[2]) == {max(g) for g in groups.values()}
    want = least_links({i: shingles(t, 5) for i, t in ids[2].items()}, 80, 100)
    assert set(ids[3]) == {i for i in ids[2] if want[i] == i}
    last = corpus_pipeline.STAGES[-1][1](spark, steps[-1], SF)
    assert {r["doc_id"] for r in last.collect()} == set(ids[4])


def test_restored_stretches_equal_whole_texts():
    """Searching only stretches with a hit reads the same words as searching whole texts."""
    rng = random.Random(3)
    signs = ["a", "b", "xx", " ", " ", " ", "1", "$", "!", "€", "£", ".", "-", "_", "\n", "é", "aaa", "0", "@", "|", "word", "  ", "É", "中"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    counts = np.random.default_rng(1).integers(0, 50, toxicity.SYMBOLS**3)
    model = toxicity.CharacterModel.of_counts(counts)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    coded, bounds = toxicity._restored_symbols(np.frombuffer(b"".join(raw), np.uint8), offsets, model)
    for k, t in enumerate(texts):
        assert np.array_equal(coded[bounds[k] : bounds[k + 1]], toxicity.symbols(toxicity.restore(t, model))), t


def test_two_models_in_one_worker():
    """A worker that gets another model reads under that one, and forgets the first."""
    grams = lambda word: np.concatenate(([0, 0], toxicity.symbols(word), [0, 0])).astype(np.int64)

    def model(word):
        counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
        g = grams(word)
        np.add.at(counts, (g[:-2] * toxicity.SYMBOLS + g[1:-1]) * toxicity.SYMBOLS + g[2:], 1000)
        return toxicity.CharacterModel.of_counts(counts)

    for _ in range(3):  # a new model may lie where the last one did
        assert toxicity.restore("1ot", model("iot")).strip() == "iot"
        assert toxicity.restore("1ot", model("lot")).strip() == "lot"
    assert len(toxicity._restored[1]) == 1


def test_short_words_are_terms(spark):
    """Words of two and three letters count, also disguised ones."""
    rng = random.Random(2)
    words = ["house", "green", "river", "table", "music", "paper", "stone", "light", "field", "cloud"]
    text = lambda *more: " ".join([*(rng.choice(words) for _ in range(12)), *more])
    made = {i: (text("zab") if i % 4 == 0 else text("qu") if i % 4 == 1 else text(), int(i % 4 < 2)) for i in range(400)}
    rows = spark.createDataFrame([(i, t) for i, (t, _) in made.items()] + [(900, text("z4b")), (901, text("zab")), (902, text())], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in made.items()], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, toxicity.fit(rows, labels)).collect()}
    assert got[900] > 0.7 and got[901] > 0.7 and got[902] < 0.3 and got[1] > 0.7 and got[2] < 0.3


def test_span_hashes_keep_no_table_as_long_as_the_data():
    """Hashes of a long slice are those of its spans alone, and what a worker keeps afterwards is small."""
    import tracemalloc

    from haggle.llm.arrays import span_hashes

    data = np.frombuffer(random.Random(2).randbytes(3_000_000), np.uint8)
    starts = np.array([0, 5, 4096, 70_000, 2_999_990], np.int64)
    tracemalloc.start()
    got = span_hashes(data, starts, starts + 10).tolist()
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 1 << 20
    assert got == [int(span_hashes(data[s : s + 10], np.array([0]), np.array([10]))[0]) for s in starts]
