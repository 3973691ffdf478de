"""BPE, chunks, decontamination, quality, personal data."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import bpe, chunks, decontaminate, pii, quality
from folioforge.llm.queries import word_bpe_path

random.seed(5)
WORDS = ["".join(random.choices("abcdefghij", k=random.randint(2, 9))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


ODD = [(1, None, "s", "k"), (2, "", None, None), (None, "lonely", "s", "k"), (3, " \n\t ", "s", "k"), (4, "x" * 5000, "s", "k"), (5, "Ünïcödé \u0000\u0001\u0002 漢字 😀", "s", "k"), (5, "Ünïcödé \u0000\u0001\u0002 漢字 😀", "s", "k")]


# BPE -------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    tokenizers = pytest.importorskip("tokenizers")
    return bpe.Tokenizer(word_bpe_path()), tokenizers.Tokenizer.from_file(word_bpe_path())


def test_bpe_matches_the_library(pair):
    mine, theirs = pair
    r = random.Random(1)
    texts = [prose(200, k) for k in range(20)] + [t or "" for _, t, _, _ in ODD]
    texts += ["a<|endoftext|>b <|startoftext|>", "İSTANBUL ΣΑΣ", "don't 12³½ x\x1cy\x85z​ é", "<|endoftext", "ǅ ŉ ß ﬁ ẞ ١٢", "é", "'s's'S_"]
    texts += ["".join(r.choice("aeinrst") for _ in range(n)) for n in (70, 3000, 12_000)] + ["a" * 9000, "!" * 6000, "é" * 5000]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == want, t[:40]
        assert mine.joined(want) == theirs.decode(want, skip_special_tokens=False)


def test_transducer_emits_early_and_keeps_little(pair):
    v = pair[0].v
    assert 0 < v.lookahead < 10_000
    word = "".join(random.Random(2).choice("aeinrst") for _ in range(60_000)).encode()
    enc = bpe.Encoder(v, window=256)
    out, most = [], 0
    for lo in range(0, len(word), 100):
        out += enc.push(word[lo : lo + 100])
        most = max(most, len(enc.held))
    assert len(out) > 0 and most <= v.lookahead + 2 * 256 + 101
    assert out + enc.finish() == v.merged([*[v.single[b] for b in word[:-1]], v.final[word[-1]]])


def test_decoder_is_incremental(pair):
    t = pair[0]
    ids = t.encode("grün 漢字 😀!")
    d = bpe.Decoder(t.bytes_of)
    assert "".join(d.push([i]) for i in ids) + d.finish() == t.text(ids) == "grün 漢字 😀! "


def test_texts_in_pieces(pair, monkeypatch):
    mine, theirs = pair
    r = random.Random(9)
    runs = ["a", "lower", "!!", "'s", "'re'", "é", "e\u0301", "漢", "<|endoftext|>", "<|", "7", " ", "\n", "Ünï", "...", "\u3000", "ᄀ", "ᅡ"]
    texts = ["".join(r.choice(runs) for _ in range(400)) for _ in range(30)] + ["".join(r.choice(runs[:6]) for _ in range(600)) for _ in range(10)] + ["x" * 30_000, "=" * 9_000, "字" * 5000]
    for piece in (40, 300):
        monkeypatch.setattr(bpe, "PIECE", piece)
        for t in texts:
            assert mine.encode(t) == theirs.encode(t, add_special_tokens=False).ids, t[:60]


def test_early_tokens_equal_whole_merging_for_any_merge_list(tmp_path):
    import json

    for seed in range(25):
        r = random.Random(seed)
        vocab = {c: i for i, c in enumerate([*bpe.byte_alphabet().values(), *(c + "</w>" for c in bpe.byte_alphabet().values())])}
        known, merges = list("abc"), []
        for _ in range(r.randint(3, 40)):
            a, b = r.choice(known), r.choice(known)
            if len(a + b) <= 12 and a + b not in vocab:
                vocab[a + b] = len(vocab)
                known.append(a + b)
                merges.append(f"{a} {b}")
        if r.random() < 0.7:
            a = r.choice(known)
            if a + "b</w>" not in vocab:
                vocab[a + "b</w>"] = len(vocab)
                merges.insert(r.randint(0, len(merges)), f"{a} b</w>")
                merges.sort(key=lambda m: max((merges.index(x) for x in merges if x.replace(" ", "") in m.split()), default=-1))
        path = tmp_path / f"{seed}.json"
        path.write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": merges, "end_of_word_suffix": "</w>"}}))
        v = bpe.Vocabulary(str(path))
        for _ in range(20):
            word = "".join(r.choice("aabbc") for _ in range(r.randint(1, 300))).encode()
            assert bpe.Encoder(v, window=r.randint(1, 9)).word(word) == v.merged([*[v.single[b] for b in word[:-1]], v.final[word[-1]]]), (seed, word)


def test_memory_stays_level_on_a_text_of_100_mb(pair):
    import resource

    t, piece = pair[0], (prose(12_000, 4) + " ")[: bpe.PIECE]
    for ids in t.stream([piece] * 2):
        list(ids)
    before, count = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0
    for ids in t.stream(piece for _ in range(100_000_000 // len(piece))):
        count += sum(1 for _ in ids)
    for ids in t.stream("abcdefgh" * 8000 for _ in range(16)):  # one word of a million letters
        count += sum(1 for _ in ids)
    assert count > 10_000_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60_000


def test_common_words_stay_in_the_memo(pair, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 40)
    memo, made = bpe.Memo(pair[0].v), []
    word = memo.encoder.word
    memo.encoder.word = lambda data: made.append(data) or word(data)
    for k in range(400):
        for w in ("the", f"w{k}"):
            assert memo[w] == tuple(word(w.encode()))
            assert len(memo) + len(memo.older) <= 40
    assert made.count(b"the") == 1


def test_bpe_operator_on_odd_rows(frame):
    got = bpe.tokenize(frame(ODD), word_bpe_path()).collect()
    assert len(got) == len(ODD) and {(r.doc_id, len(r.ids)) for r in got if r.doc_id in (1, 2, 3)} == {(1, 0), (2, 0), (3, 0)}
    assert bpe.tokenize(frame([]), word_bpe_path()).count() == 0


# Chunks ----------------------------------------------------------------------------------------------------------------


def test_boundaries_are_local():
    a, b = prose(400, 1).encode(), b"inserted words " + prose(400, 1).encode()
    ends = [set(chunks.boundaries(np.frombuffer(x, np.uint8), np.array([0, len(x)]))) for x in (a, b)]
    late = {e for e in ends[0] if e > chunks.SPAN + chunks.REACH}
    assert len(late) > 20 and {e + 15 for e in late} <= ends[1]


def test_sliding_max():
    h = np.random.default_rng(0).integers(1, 1000, 500).astype(np.uint64)
    want = [max(h[max(0, i - 24) : i], default=0) for i in range(500)]
    assert chunks.sliding_max(h, 24).tolist() == want


def test_repeated_passages_are_found_and_clean_texts_are_not(frame):
    passage = prose(60, 99)
    rows = [(k, prose(150, 1000 + k) + " " + passage + " " + prose(90, 2000 + k) if k % 4 == 0 else prose(300, 3000 + k), "s", "k") for k in range(40)]
    got = chunks.repeats(frame(rows)).collect()
    assert {r.doc_id for r in got} == {k for k in range(40) if k % 4 == 0}
    texts = {k: t.encode() for k, t, _, _ in rows}
    for r in got:
        part = texts[r.doc_id][r.start : r.start + r.bytes].decode()
        assert part in passage or passage in part or len(set(part.split()) & set(passage.split())) > 25
        assert r.kept == (r.doc_id == r.first) and 2 <= r.copies <= 10
    assert all(any(r.first == 0 and r.copies > 5 for r in got if r.doc_id == k) for k in range(0, 40, 4))
    kept = {r.doc_id: r.text for r in chunks.deduplicated(frame(rows)).collect()}
    assert kept[0] == rows[0][1] and len(kept[4]) < len(rows[4][1]) - 150 and kept[1] == rows[1][1]


def test_tables_of_numbers_meet_only_their_copies(frame, spark):
    r = random.Random(14)
    row = lambda: " ".join(str(r.randint(1, 99_999)) for _ in range(60))
    item, docs = row(), [(k, row(), "s", "k") for k in range(30)]
    docs += [(100, prose(20, 1) + " " + docs[0][1], "s", "k"), (101, prose(20, 2) + " " + item, "s", "k")]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    known = decontaminate._windows(items, "item_id", "text", None)
    assert [x.doc_id for x in decontaminate.leaks(frame(docs), items).collect()] == [101]
    shared = spark.sparkContext.broadcast((decontaminate.sieve_of(known), []))
    met = decontaminate._windows(frame(docs), "doc_id", "text", shared).join(known.select("mode", "h"), ["mode", "h"])
    assert {x.key for x in met.select("key").distinct().collect()} == {101}


def test_passages_of_accented_texts_and_clashing_columns(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("äéîøß漢字😀жabc") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(80)
    rows = [(k, f"{text(60)} {passage} {text(60)}", k, "x") for k in range(12)] + [(50 + k, text(150), k, "y") for k in range(6)] + [(None, passage, 1, "z"), (99, None, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _cut int, digest string")
    got = {x.doc_id: x for x in chunks.deduplicated(docs).collect()}
    assert got[0].text == rows[0][1] and got[None].text == passage and got[99].text is None and all(got[50 + k].text == rows[12 + k][1] for k in range(6))
    for k in range(1, 12):
        assert len(got[k].text) < len(rows[k][1]) - 200 and rows[k][1].startswith(got[k].text[:100]) and got[k]["_cut"] == k
    data = "".join(t or "" for _, t, *_ in rows[:12]).encode()
    ends = chunks.boundaries(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(ends) > 100 and all(data[e] & 0xC0 != 0x80 for e in ends if e < len(data))


@pytest.mark.parametrize("letters,least", [((2, 9), 60), ((2, 4), 57)])
def test_passages_of_51_words(frame, letters, least):
    r = random.Random(13)
    text = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(*letters))) for _ in range(n))
    rows = []
    for k in range(60):
        passage = text(51)
        rows += [(2 * k + i, f"{text(40)} {passage} {text(40)}", "s", "k") for i in (0, 1)]
    found = {x.doc_id // 2 for x in chunks.repeats(frame(rows)).collect()}
    assert len(found) >= least


def test_chunks_on_odd_rows(frame):
    parts = chunks.chunked(frame(ODD)).collect()
    for k, t, _, _ in ODD[2:5]:
        assert sum(p.n for p in parts if p.key == k) == len(t.encode())
    assert chunks.repeats(frame(ODD)).columns == ["doc_id", "start", "bytes", "words", "copies", "first", "kept"]
    assert chunks.repeats(frame([])).count() == 0 and chunks.deduplicated(frame(ODD)).count() == len(ODD)


# Decontamination -------------------------------------------------------------------------------------------------------


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_leaks_are_caught_reparameterised_too(spark, frame):
    item = "The train leaves Berlin at 9 and travels 120 km toward Hamburg while another train covers 80 km from Bremen; when do they meet near the old bridge"
    other = item.replace("120", "450").replace("80", "95").replace("Berlin", "Madrid").replace("Hamburg", "Toledo").replace("Bremen", "Burgos").replace(" 9 ", " 7 ")
    twisted = item.replace("km toward", "km away")
    rows = [(1, prose(50, 1) + ". " + item + ". " + prose(50, 2), "s", "k"), (2, prose(50, 3) + "! " + other + ". " + prose(9, 4), "s", "k"), (3, prose(200, 5), "s", "k"), (4, item[:60], "s", "k"), (5, (prose(5, 6) + " " + item).upper(), "s", "k")]
    found = {r.doc_id: r for r in decontaminate.leaks(frame(rows), items(spark, [item, prose(30, 77), None, ""])).collect()}
    assert set(found) >= {1, 2} and not {3, 4} & set(found)
    assert found[1].exact > 0.99 > found[2].exact and found[2].consistent == 1.0
    assert [r.item_id for r in found.values()] == [0] * len(found) and twisted
    left = {r.doc_id for r in decontaminate.cleaned(frame(rows), items(spark, [item])).collect()}
    assert {3, 4} <= left and not {1, 2} & left


def test_leaks_in_other_guises_are_caught(spark, frame):
    bridge = "The train leaves Berlin at 9 and travels 120 km toward Hamburg while another train covers 80 km from Bremen; when do they meet near the old bridge"
    apples = "Tom has 5 apples. Mary has 3 apples. Tom gives Mary 2 apples. How many apples does Mary have"
    tank = "A tank holds 300 l and 12 kg of salt; how much is left when 40 l have run out of it"
    short = "Name the largest lake of Finland"
    copies = {
        1: bridge.upper(), 2: bridge.lower(), 3: apples.replace("Tom", "Ann").replace("Mary", "Bob").replace("5", "7"),
        4: tank.replace("300", "1,250").replace("12", "12.5"), 5: short.lower(), 6: apples.upper().replace("5", "1,005"),
    }
    want = {1: 0, 2: 0, 3: 1, 4: 2, 5: 3, 6: 1}
    rows = [(k, prose(40, k) + ". " + t + ". " + prose(30, 50 + k), "s", "k") for k, t in copies.items()] + [(k, prose(300, 700 + k), "s", "k") for k in range(10, 30)]
    rows += [(40, prose(30, 1) + " the largest lake. " + prose(9, 2), "s", "k"), (41, prose(20, 3) + " yes. " + prose(20, 4), "s", "k")]
    known = items(spark, [bridge, apples, tank, short, "Yes", ""])
    got = decontaminate.leaks(frame(rows), known).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(want.items()) and len(got) == len(want)
    assert {r.doc_id for r in decontaminate.cleaned(frame(rows), known).collect()} == {r[0] for r in rows} - set(want)


def test_documents_are_searched_once_for_both_sums(spark, frame):
    item = prose(40, 5)
    done = decontaminate.leaks(frame([(1, item, "", "")]), items(spark, [item]))
    assert "MapInArrow" not in done._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, r.exact) for r in done.collect()] == [(1, 1.0)]


def test_windows_match_a_plain_version():
    texts = [prose(40, k) for k in range(5)] + ["", "one two", "A 12 km Xy"]
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    token, value, rows, place = decontaminate.template(data, offs)
    for i, t in enumerate(texts):
        assert (rows == i).sum() == len(re.findall(r"[A-Za-z0-9]+", t))
    last = token[rows == 7]
    assert last[1] == decontaminate.NUMBER and last[2] == decontaminate.UNIT and last[3] == decontaminate.NAME
    _, at = decontaminate.windows(token, rows)
    assert np.bincount(rows[at], minlength=8).tolist() == [33] * 5 + [0, 1, 1]


def test_decontamination_on_odd_rows(spark, frame):
    assert decontaminate.leaks(frame(ODD), items(spark, [])).count() == 0
    assert decontaminate.leaks(frame([]), items(spark, [prose(20, 1)])).count() == 0
    assert decontaminate.cleaned(frame(ODD), items(spark, [prose(20, 1)])).count() == len(ODD)


# Quality ---------------------------------------------------------------------------------------------------------------


def test_trees_learn_and_flat_arrays_agree():
    r = np.random.default_rng(1)
    x = r.random((2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x[:1500], y[:1500], trees=40, depth=3)
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95

    def one(row, at):
        while model.left[at] != at:
            at = model.left[at] if row[model.feature[at]] <= model.cut[at] else model.right[at]
        return model.value[at]

    assert model.margin(x[:20]) == pytest.approx([model.base + sum(one(row, t) for t in model.roots) for row in x[:20]])


def test_quality_held_out_and_odd_rows(spark, frame):
    rows = [(k, prose(80, k) if k % 3 else prose(80, k).upper().replace(" ", "!! "), "s", "k") for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)], "doc_id long, quality int")
    model = quality.train(frame(rows), labels)
    got = quality.score(frame(rows + ODD), model, ["doc_id"]).collect()
    assert len(got) == 300 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 300]
    assert np.mean([(r.score > 0.5) == (r.doc_id % 3 > 0) for r in held]) > 0.95
    empty = quality.train(frame([]), labels)
    assert [round(r.score, 3) for r in quality.score(frame(ODD[:1]), empty, ["doc_id"]).collect()] == [0.5]


# Personal data -----------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_brute_force(frame):
    r = random.Random(3)
    texts = [
        "a@b.co_x@d.com a@b a.b@c-d.e.f.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3", "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111x", "+1 (017) 555-7713 +12 +1 2345678901234567 +49-30-901820.",
        "ü😀 x@y.zz +44 20 7946 0958\u0001\u0002 10.0.0.1", "9" * 20_000, "a" * 20_000 + "@", "+1" + "(" * 5000, "1-" * 6000, "x@y" + ".z" * 8000, *["".join(r.choice("01 .-+@a()") for _ in range(400)) for _ in range(120)],
    ]
    rows = [(i, t, "s", "k") for i, t in enumerate(texts)] + [(900 + i, t, s, k) for i, (_, t, s, k) in enumerate(ODD)]
    got = pii.find(frame(rows)).select("doc_id", "base").collect()
    for row in got:
        text = next(t for k, t, _, _ in rows if k == row.doc_id)
        assert [(s.kind, s.s, s.e) for s in row.base] == plain(text), text[:80]


def test_judge_and_its_sql(spark):
    drawn = [pii.grammar(random.Random(77 + k)) for k in range(400)]
    model, cuts = pii.judge()
    want = model.margin(np.array([pii.candidate_features(*c[:4]) for c in drawn], np.float32))
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(drawn)], "i int, g int, m string, b string, a string")
    for g in range(len(pii.GENERATORS)):
        part = rows.where(f"g = {g}").select("i", F.struct("m", "b", "a").alias("x"))
        part = part.select("i", F.array(*[c.cast("double") for c in pii.candidate_sql(g, F.col("x"))]).alias("f")).withColumn("p", F.expr(pii.tree_sql(model)))
        for r in part.collect():
            assert r.p == pytest.approx(want[r.i], abs=1e-4)
    p = 1 / (1 + np.exp(-want))
    right = [(p[i] >= cuts[c[0]]) == bool(c[4]) for i, c in enumerate(drawn)]
    assert np.mean(right) > 0.9


def test_further_spans_and_redaction(frame):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'say token = "{key}" and mail me@x.org. ' + prose(40, 8) + " " + "-" * 40
    row = pii.find(frame([(1, text, "s", "k"), (2, prose(200, 9), "s", "k")])).withColumn("text", F.lit(text)).withColumn("clean", pii.redacted(F.col("text"), F.concat("base", "more"))).orderBy("doc_id").collect()
    assert [(s.kind, text[s.s : s.e]) for s in row[0].more] == [("secret", key)] and not row[1].more and not row[1].base
    assert row[0].clean.startswith('say token = "[SECRET]" and mail [EMAIL]. ') and row[0].clean.endswith(text[-80:])


def test_long_secrets_and_accounts_are_whole(frame):
    r = random.Random(5)
    drawn = lambda alphabet, n: "".join(r.choices(alphabet, k=n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    accounts = ["DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3026 606", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947"]
    secrets = [drawn(letters + "0123456789", 441), drawn(letters, 40), drawn(letters + "0123456789+/", 2000) + "=="]
    spans = [("secret", f'the token = "', m, '" ends here') for m in secrets] + [("account", "paid to iban ", m, " before noon") for a in accounts for m in (a, a.replace(" ", ""))]
    rows = [(k, b + m + e, "s", "k") for k, (_, b, m, e) in enumerate(spans)]
    rows += [(100, "a row " + "-" * 441 + " and " + "a-slug-of-words-" * 30 + " end", "s", "k")]
    got = {x.doc_id: x for x in pii.find(frame(rows), keep=("text",)).withColumn("clean", pii.redacted(F.col("text"), F.concat("base", "more"))).collect()}
    for k, (kind, b, m, e) in enumerate(spans):
        assert not set(re.findall("[A-Za-z0-9+/=]+", m)) & set(re.findall("[A-Za-z0-9+/=]+", got[k].clean)), (m, got[k].clean)
        if kind == "secret" or not got[k].base:
            assert got[k].clean == f"{b}[{kind.upper()}]{e}"
    assert got[100].clean == got[100].text


def test_recall_of_further_spans_in_several_languages(frame):
    planted = {
        "id_number": ["Ausweis 123-45-6789 liegt bei", "her SSN: 078-05-1120 was on file", "número 219-09-9999 del titular", "identité 457-55-5462 reçue", "social security number 321-54-9876"],
        "spelled_email": ["reach jane.doe at example dot com today", "schreiben an max(at)firma(dot)de bitte", "correo ana_lopez [at] correo [dot] es ahora", "p.martin at exemple dot fr", "write to joe99[at]mail[dot]org"],
        "account": ["überwiesen auf DE89370400440532013000 gestern", "GB29 NWBK 6016 1331 9268 19 is hers", "versez au compte FR1420041010050500013026606", "conto NL91 ABNA 0417 1643 00"],
        "local_phone": ["Telefon (030) 555-0123 anrufen", "phone 212-555-0187 after six", "teléfono 555 010 4477 por la tarde", "téléphone 555.013.9911", "Call (415) 555-2671"],
        "secret": ["Passwort: x8Kq2LmZ0pRt5VyB7nWc", "clave = 'qL93nfKe02MdpX7TzUa1'", "uses ghp_a8F3kLmN0pQr5TuVwXyZ1b2C4d6E here", "token sk-9fK3mQpZ7xVbN2LrT8wYc5H1"],
    }
    rows = [(k, prose(20, 400 + k) + " " + text + " " + prose(5, 500 + k), kind, "k") for k, (kind, text) in enumerate((kind, t) for kind, ts in planted.items() for t in ts)]
    rows += [(1000 + k, prose(80, 900 + k), "", "k") for k in range(20)]
    rows += [(2000 + k, prose(9, 950 + k) + t, "", "k") for k, t in enumerate([" commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 fixed it", " she is at home dot the end", " order 123-45-6789 shipped", " ISBN 212-555-0187", " a-long-slug-of-words-in-a-link", " ====================================="])]
    got = {r.doc_id: {s.kind for s in r.more} for r in pii.find(frame(rows)).collect()}
    missed = [r[1] for r in rows if r[2] and r[2] not in got[r[0]]]
    assert len(missed) <= 2, missed
    assert [r[1] for r in rows if not r[2] and got[r[0]]] == []


def test_private_columns_do_not_clash(frame):
    rows = frame([(1, "write me@x.org", "s", "k")]).withColumnsRenamed({"source": "_t", "key": "_email"}).withColumn("_g0", F.lit(1)).withColumn("_digits", F.lit("x"))
    got = pii.find(rows, keep=("text", "_t", "_email", "_g0", "_digits")).first()
    assert (got["_t"], got["_email"], got["_g0"], got["_digits"], len(got.base)) == ("s", "k", 1, "x", 1)


def test_crc_of_keys(frame):
    from folioforge.llm.queries import crc_of

    assert [r.c for r in frame([(12, "", "", ""), (5, "", "", "")]).select(crc_of("doc_id").alias("c")).collect()] == [zlib.crc32(b"12"), zlib.crc32(b"5")]
