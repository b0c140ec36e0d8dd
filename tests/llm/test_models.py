import zlib

import numpy as np
from pyspark.sql import functions as F

from reelgraph.llm import decontam, langid, toxicity, urlfilter
from reelgraph.llm.common import held_out, table

from ..conftest import DATA


def test_held_out_rows(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_languages(spark, odd, empty):
    docs = table(spark, DATA, "documents")
    r = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.9 and r.score.between(0, 1).all()
    # Neither the rows that are held out nor the label of a row sway its prediction.
    shuffled = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert {tuple(x) for x in langid.identify(shuffled).collect()} == {tuple(x) for x in langid.identify(docs).collect()}
    got = {(x["doc_id"], x["lang_pred"]) for x in langid.identify(odd).collect()}
    assert {(1, "und"), (2, "und"), (7, "und"), (8, "und"), (None, "und")} <= got and langid.identify(odd).count() == odd.count()
    assert langid.identify(empty).count() == 0
    kept = langid.keep_known(odd)
    assert kept.schema == odd.schema and {x["doc_id"] for x in kept.collect()} == {None, 3, 4, 5, 6, 9, 10}


def test_kernel_counts_shared_ngrams():
    """The matrix product is the number of hashed n-grams that two texts share, over the root of their numbers."""
    def bins(text):
        return {((int.from_bytes(text[k : k + n], "big") * 0x9E3779B1 + (n * 0x7F4A7C15 & 0xFFFFFFFF)) & 0xFFFFFFFF) >> 18 for n in range(1, 5) for k in range(len(text) - n + 1)}

    texts = [b"", b"a", b"the cat sat", "le chat \xe9tait l\xe0".encode(), b"the cat sat on the mat " * 30, bytes(range(256)) * 1100]
    rows = langid.presence(texts)
    assert [set(np.flatnonzero(r).tolist()) for r in rows] == [bins(t) for t in texts]
    landmarks = rows[2:].T.astype(np.float32)
    got = langid.kernel(rows, landmarks, landmarks.sum(axis=0))
    want = [[len(bins(a) & bins(b)) / (max(len(bins(a)), 1) * len(bins(b))) ** 0.5 for b in texts[2:]] for a in texts]
    assert np.allclose(got, want, atol=1e-5)


def test_unknown_languages_go(spark):
    import base64
    import random

    random.seed(1)
    docs = table(spark, DATA, "documents").select("doc_id", "text", "lang")
    junk = ["a " * 500, "b" * 3000, base64.b64encode(random.randbytes(900)).decode(), base64.b64encode(random.randbytes(90_000)).decode(), random.randbytes(900).hex()]
    junk += ["Все люди рождаются свободными и равными в своем достоинстве и правах. " * 3]
    both = docs.unionByName(spark.createDataFrame([(10_000_000 + k, t, None) for k, t in enumerate(junk)], docs.schema))
    kept = {r["doc_id"] for r in langid.keep_known(both).collect()}
    clean = {r["doc_id"] for r in docs.where(r"text rlike '\\p{L}'").collect()}
    assert not [k for k in kept if k >= 10_000_000] and len(kept & clean) >= 0.995 * len(clean)


def test_restored_words(spark):
    docs = spark.createDataFrame([(i, "you idiot loser trash moron stupid worthless disgusting are the one who was here") for i in range(40)], "doc_id long, text string")
    r = toxicity.Restorer(toxicity.character_model(toxicity.character_counts(docs)))
    for disguise, word in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "l0ser": "loser", "tr@$h": "trash", "m0r0n": "moron", "loooser": "loser", "w0rthl3ss": "worthless", "idiot": "idiot"}.items():
        assert r.word(disguise) == word
    assert r.restored(["hello 1d10t", "plain words", "i d i o t", None, ""]) == ["idiot", "", "idiot", "", ""]


def test_restored_to_the_end(spark):
    said = "you idiot loser trash moron stupid worthless disgusting are the one who was here a fête"
    docs = spark.createDataFrame([(i, said) for i in range(40)], "doc_id long, text string")
    r = toxicity.Restorer(toxicity.character_model(toxicity.character_counts(docs)))
    late = "you are the one who was here " * 8 + "stupid"
    spaced, joined = " ".join(late.replace(" ", "")), ".".join(late.replace(" ", ""))
    assert len(late) > 4 * toxicity.LONGEST
    for hidden in (spaced, joined):
        assert "stupid" in r.restored([hidden])[0].split()
    assert "idiot" in r.restored(["y o u i d i o t"])[0].split()
    assert r.restored(["f ê t e", "worthles$"]) == ["fête", "worthless"]


def plain_decoding(word, model, parted):
    """The best cost over all that may have been meant, path by path."""
    paths = [("", "", 0.0, (0, 0))]
    for at, sign in enumerate(word):
        stretched = sign * 3 in word[max(0, at - 2) : at + 3]
        options = [(sign, 0.0)] if sign.isalpha() else [(c, toxicity.SIGN) for c in toxicity.LEET.get(sign, "")]
        if not sign.isalpha():
            options.append(("", toxicity.LOST if options else toxicity.LEFT_OUT))
        after = []
        for text, last, cost, (two, one) in paths:
            for c, extra in options:
                if not c:
                    after.append((text, last, cost + extra, (two, one)))
                    continue
                k = toxicity.CODES.get(c, toxicity.OTHER)
                after.append((text + c, c, cost + extra + model[two, one, k], (one, k)))
                if parted and one:
                    after.append((text + " " + c, c, cost + extra + model[two, one, 0] + model[0, 0, k], (0, k)))
                if c == last and stretched:
                    after.append((text, last, cost + extra + toxicity.STRETCHED, (two, one)))
        paths = after
    return max((cost + model[two, one, 0], text) for text, _, cost, (two, one) in paths)


def test_decoding_is_exact(spark):
    import random

    random.seed(4)
    docs = spark.createDataFrame([(i, "you idiot loser trash moron stupid worthless disgusting are the one who was here") for i in range(40)], "doc_id long, text string")
    model = toxicity.character_model(toxicity.character_counts(docs))
    for _ in range(150):
        word = "".join(random.choice("idot1105|!.e@aaxlls$é") for _ in range(random.randint(1, 8)))
        for parted in (False, True):
            cost, best = plain_decoding(word, model, parted)
            got = toxicity.restore(word, model, parted)
            same = [t for c, t in [plain_decoding(word, model, parted)] if t == got]
            assert same or abs(plain_decoding_of(word, model, parted, got) - cost) < 1e-3, (word, best, got)


def plain_decoding_of(word, model, parted, text):
    """The best cost of one reading, by a dynamic program over (signs read, letters written, last two letters)."""
    import functools

    @functools.cache
    def best(at, done, two, one):
        if at == len(word):
            return model[two, one, 0] if done == len(text) else -np.inf
        sign, out = word[at], -np.inf
        stretched = sign * 3 in word[max(0, at - 2) : at + 3]
        options = [(sign, 0.0)] if sign.isalpha() else [(c, toxicity.SIGN) for c in toxicity.LEET.get(sign, "")]
        if not sign.isalpha():
            out = best(at + 1, done, two, one) + (toxicity.LOST if options else toxicity.LEFT_OUT)
        for c, extra in options:
            k = toxicity.CODES.get(c, toxicity.OTHER)
            if text[done : done + 1] == c:
                out = max(out, extra + model[two, one, k] + best(at + 1, done + 1, one, k))
            if parted and one and text[done : done + 2] == " " + c:
                out = max(out, extra + model[two, one, 0] + model[0, 0, k] + best(at + 1, done + 2, 0, k))
            if done and text[done - 1] == c and stretched:
                out = max(out, extra + toxicity.STRETCHED + best(at + 1, done, two, one))
        return out

    return best(0, 0, 0, 0)


def test_toxicity(spark, odd, empty):
    docs, labels = table(spark, DATA.replace("0.001", "0.01"), "documents"), table(spark, DATA.replace("0.001", "0.01"), "labels")
    model = toxicity.train(docs, labels)
    r = toxicity.judge(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (r.predicted == r.toxic).mean() > 0.9 and r.score.between(0, 1).all()
    plain, hidden = model.scores(["you are an idiot and a loser", "you are an 1d10t and a l0ser"])
    assert plain > 0.5 and hidden > 0.5
    out = toxicity.judge(odd, model).toPandas()
    assert len(out) == odd.count() and (out.predicted == (out.score >= 0.5)).all()
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert toxicity.score_toxicity(odd, labels.limit(0)).where("predicted = 0").count() == odd.count()
    one = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(odd, one).where("predicted = 1").count() == odd.count()


def rule_of(host, path, rules):
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def test_urls(spark):
    urls = ["http://A.example.COM/en/1?x#y", "https://www.example.com/en/", "http://example.com", "x", None, "", "ftp://net/es/é", "http://a.net/fr/1", "http://xnet/fr/1", "http://b.example.org?q=/en/", "a://b://c/d", "http://ads.example.org/x", "http://m.news.example.org/de/9"]
    from reelgraph.llm.queries import URL_RULES

    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, None, None), (1, urls[1], "x")], "page_id long, url string, host string")
    out = urlfilter.judge(pages, URL_RULES, urlfilter.LABELLED).collect()
    assert len(out) == len(urls) + 2
    for r in out:
        u = urls[r["page_id"]] if r["page_id"] is not None else None
        host, path = urlfilter.split_url(u)
        want = rule_of(host, path, URL_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, want and want[0])
        assert r["verdict"] == (want[1] if want else "block" if r["score"] >= 0.5 else "allow") and (r["score"] is None) == bool(want)
    by = {r["page_id"]: r for r in out}
    assert (by[0]["host"], by[0]["path"], by[0]["rule"], by[0]["verdict"]) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert by[11]["verdict"] == "block" and by[12]["verdict"] == "allow" and by[2]["rule"] is None and by[9]["path"] == ""
    assert urlfilter.judge(pages.limit(0), URL_RULES, []).count() == 0


def test_url_model_on_held_out_labels():
    right = 0
    for fold in range(5):
        model = urlfilter.train([x for k, x in enumerate(urlfilter.LABELLED) if k % 5 != fold])
        right += sum((model.score(*urlfilter.split_url(u)) >= 0.5) == bool(y) for k, (u, y) in enumerate(urlfilter.LABELLED) if k % 5 == fold)
    print(f"{right} of {len(urlfilter.LABELLED)}")
    assert right / len(urlfilter.LABELLED) > 0.75
    assert urlfilter.train([]).score("a.example", "/") == 0.5


#: Host, path and rule can be said in SQL, for DuckDB; the verdict of the model can't.
RULES_SQL = """WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(rule_host, rule_path, verdict))
SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id, host, path"""


def test_rules_of_all_pages_as_duckdb_finds_them(spark):
    import duckdb

    from reelgraph.llm.queries import op4_url_filter

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = {r[0]: r[1:] for r in c.sql(RULES_SQL).fetchall()}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in op4_url_filter(spark, DATA).collect()}
    assert got == want


def test_urls_that_tell_nothing_are_allowed_under_any_ending():
    import random

    draw = random.Random(11)
    model = urlfilter.train(urlfilter.LABELLED)
    blocked = lambda host, path: model.score(host, path) >= 0.5
    syllable = lambda: "".join(draw.choice("bcdfghklmnprstvw") + draw.choice("aeiou") for _ in range(draw.randrange(2, 5)))
    found = []
    for ending in ("com", "net", "org", "io", "fr", "biz"):
        for prefix in ("", "www.", "m.", "blog."):
            hosts = [f"{prefix}{syllable()}.{draw.choice(('example.', ''))}{ending}" for _ in range(100)]
            assert sum(blocked(h, draw.choice(("/", "/en/12", "/de/7.html", "/about"))) for h in hosts) < 5
            told = [f"{prefix}{draw.choice((f'{w}-{syllable()}', f'{syllable()}-{w}'))}.{ending}" for w in ("casino", "jackpot", "viagra", "bookmaker", "adult", "warez", "betting", "spam")]
            found += [blocked(h, "/en/12") for h in told]
    assert sum(found) > 0.9 * len(found)


def plain_alignment(a, b):
    best, table = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best / (2 * len(a))


def test_alignment():
    import random

    random.seed(2)
    for _ in range(200):
        a, b = ([random.randint(0, 4) for _ in range(random.randint(1, 12))] for _ in range(2))
        score, first, last = decontam.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == plain_alignment(a, b) and 0 <= first <= last + 1 <= len(b)


def test_leaks(spark, odd, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "two words"), (5, "one two three four")], "item_id long, text string")
    words = item.split()
    edited = " ".join(w if k % 5 else "changed" for k, w in enumerate(words))
    docs = spark.createDataFrame([(10, f"Before. {item.upper()}, after"), (11, f"x {edited} y"), (12, " ".join(words[:6])), (13, "clean text"), (14, None), (15, f"{item} {item}"), (10, item), (16, "one, two; three: four!")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.leaks(docs, bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (15, 1), (16, 5)} and got[10, 1] == 1.0 > got[11, 1]
    assert decontam.leaks(empty, bench).count() == decontam.leaks(docs, bench.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in decontam.keep_clean(docs, bench).collect()) == [12, 13, 14]
    assert decontam.keep_clean(odd, bench).count() == odd.count() and decontam.keep_clean(odd, bench).columns == odd.columns


def test_items_too_short_for_a_seed(spark):
    """Held against the words of each pair: equal ones, and nothing else."""
    bench = spark.createDataFrame([(1, "Two words"), (2, "one"), (3, "two, words."), (4, " - "), (5, None), (6, "words two"), (7, "zwölf ")], "item_id long, text string")
    texts = ["two WORDS!", "two words more", "so two words", "one", "(One)", "one one", "", " ... ", None, "Zwölf", "two", "words, two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    want = sorted((d, r["item_id"]) for d, t in enumerate(texts) for r in bench.collect() if words(t) and words(t) == words(r["text"]))
    rows = decontam.leaks(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == want and len(want) == 6
    assert {(r["score"], r["first_word"], r["last_word"], r["passage"]) for r in rows if r["item_id"] == 1} == {(1.0, 0, 1, "two words")}
    assert sorted(r["doc_id"] for r in decontam.keep_clean(docs, bench).collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})


def test_rows_are_judged_by_their_text(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"it is {item}"), (None, "clean"), (1, item), (1, "clean too"), (2, None), (2, "")]
    kept = decontam.keep_clean(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "-") for r in kept) == [(0, "clean"), (1, "clean too"), (2, "-"), (2, "-")]


def test_recall_on_edited_copies(spark):
    """Copies with 10 to 40 % of the words changed, left out or added; all pairs aligned give the truth."""
    import random

    random.seed(11)
    vocabulary = [f"w{k}" for k in range(3000)] + [f"c{k}" for k in range(60)] * 10
    say = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [say(random.randint(8, 60)) for _ in range(40)]
    docs = []
    for k, item in enumerate(items):
        for share in (0.1, 0.2, 0.3, 0.4):
            words = []
            for w in item:
                kind = random.choice("rid") if random.random() < share else ""
                words += {"": [w], "r": say(1), "i": [w, *say(1)], "d": []}[kind]
            docs.append((len(docs), " ".join(say(random.randint(0, 300)) + words + say(random.randint(0, 300)))))
        docs.append((len(docs), " ".join(say(50) + [w if i % 3 else "other" for i, w in enumerate(item)] + say(50))))
    docs += [(len(docs) + k, " ".join(say(200))) for k in range(40)]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    number = {w: np.uint64(k) for k, w in enumerate({w for _, t in docs for w in t.split()} | {w for i in items for w in i})}
    coded = [np.array([number[w] for w in i], np.uint64) for i in items]
    want = {}
    for d, t in docs:
        text = np.array([number[w] for w in t.split()], np.uint64)
        for k, item in enumerate(coded):
            score = decontam.align(item, text)[0]
            if score >= decontam.LEAST_SCORE:
                want[d, k] = score
    recall = len(got.keys() & want.keys()) / len(want)
    print(f"recall {recall:.3f} of {len(want)} pairs")
    assert got.items() <= want.items() and recall >= 0.9 and len(want) > 120


def test_one_item_many_times_and_long_texts(spark):
    item = " ".join(f"i{k}" for k in range(12))
    long = " ".join(f"x{k % 5000}" for k in range(400_000))
    docs = spark.createDataFrame([(1, f"{item} " * 20_000), (2, f"{long} {item} {long}"), (3, long), (4, " ".join(item.split()[:5]) + " z " * 30 + item)], "doc_id long, text string")
    got = {r["doc_id"]: (r["score"], r["first_word"]) for r in decontam.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (1.0, 0), 2: (1.0, 400_000), 4: (1.0, 35)}


def test_leaks_in_blocks(spark, monkeypatch):
    docs, bench = table(spark, DATA, "documents"), table(spark, DATA, "benchmark")
    one = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 3000)
    assert one and {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()} == one
    texts, items = docs.collect(), bench.collect()
    assert {(d["doc_id"], i["item_id"]) for d in texts for i in items if i["text"] in d["text"]} <= one
