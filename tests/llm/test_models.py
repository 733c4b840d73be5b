import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiforge.llm import common, context_tree, language_id, ngrams, packing, perplexity, quality_rules, toxicity

from .conftest import SF
from .test_tokens import verify_packing


def crc(doc):
    return zlib.crc32(str(doc).encode()) % 5


def words(text):
    return [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]


# context-tree weighting


def brute_bit_trees(texts, depth):
    """Counts of zeros and ones of each (context bytes, bits so far), nearest byte first."""
    n = collections.defaultdict(lambda: [0, 0])
    for t in texts:
        data = b"\n" * depth + b" ".join(words(t)) + b"\n"
        for i in range(depth, len(data)):
            for k in range(depth + 1):
                context = data[i - k : i][::-1]
                for bit in range(8):
                    n[context, bit, data[i] >> (8 - bit)][data[i] >> (7 - bit) & 1] += 1
    return n


def brute_score(texts, text, depth):
    n = brute_bit_trees(texts, depth)
    kt = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(c[0] + c[1] + 1) - math.log(math.pi)
    children = collections.defaultdict(list)
    for context, bit, prefix in list(n):
        if context:
            children[context[:-1], bit, prefix].append((context, bit, prefix))
    memo = {}

    def logpw(node):
        if node not in memo:
            memo[node] = kt(n[node]) if len(node[0]) == depth else math.log(0.5) + np.logaddexp(kt(n[node]), sum(map(logpw, children[node])))
        return memo[node]

    out, data = 0.0, b"\n" * depth + b" ".join(words(text)) + b"\n"
    for i in range(depth, len(data)):
        for bit in range(8):
            p, one = None, data[i] >> (7 - bit) & 1
            for k in range(depth, -1, -1):
                node = (data[i - k : i][::-1], bit, data[i] >> (8 - bit))
                c = n.get(node, [0, 0])
                own = (c[one] + 0.5) / (sum(c) + 1)
                if k == depth:
                    p, seen = own, sum(c) > 0
                    continue
                share = math.exp(math.log(0.5) + kt(c) - logpw(node)) if sum(c) else 0.5
                p = share * own + (1 - share) * (p if seen else own)
                seen = sum(c) > 0
            out += math.log10(p)
    return out


def test_scores_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat", "the dog sat on a log", "a cat and a dog", "The mat and the log", "zebra quick", "the cat", None, "mat mat mat"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = [t for i, t in rows if crc(i) != 1]
    seen = []
    for size, most in ((40, 10**6), (10**6, 10**6), (40, 0), (40, 30)):  # many blocks, one block; all broadcast, none, some
        found = {r["doc_id"]: r for r in context_tree.scored(df, block_bytes=size, often_grams=most, often_words=most).collect()}
        seen.append({k: tuple(r) for k, r in found.items()})
        for i, t in rows:
            own = brute_score(train, t, context_tree.DEPTH)
            assert found[i]["held_out"] == (crc(i) == 1) and found[i]["score"] == pytest.approx(own, abs=2e-4)
            n = len(b" ".join(words(t))) + 1
            assert found[i]["n_bytes"] == n and found[i]["bits_per_byte"] == pytest.approx(-own / math.log10(2) / n, abs=2e-3)
    assert seen[0] == seen[2] == seen[3] and seen[0].keys() == seen[1].keys()


def test_lookup_finds_all_and_nothing_else():
    rnd = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rnd.integers(0, 2**48, 50_000, dtype=np.uint64), np.arange(3000, dtype=np.uint64)]))
    rnd.shuffle(keys)
    table = ngrams.Lookup(keys, np.arange(len(keys), dtype=float))
    at = rnd.integers(0, len(keys), 200_000)
    assert (table(keys[at]) == at).all() and len(ngrams.Lookup(keys[:0], np.zeros(0))(keys[:0])) == 0
    assert np.isnan(table(np.arange(2**50, 2**50 + 100, dtype=np.uint64))).all()
    with pytest.raises(KeyError):
        ngrams.sums([b"abc"], [table], 5)


def test_alike_rows_are_spread_over_blocks(spark):
    df = spark.range(6000).select(F.lit(None).cast("bigint").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("the very same text").alias("text"))
    rows = [r[0] for r in ngrams.blocks(df, "doc_id", "text", 4000).groupBy("__block").count().select("count").collect()]
    assert len(rows) > 10 and max(rows) < 2 * 6000 / len(rows)
    found = context_tree.scored(df, block_bytes=4000).groupBy("n_tokens", "score").count().where("n_tokens = 5").collect()
    assert len(found) == 1 and found[0]["count"] == 4000


def test_score_query(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    count = collections.Counter(w for i, t in rows if crc(i) != 1 for w in [*words(t), None])
    total, distinct = sum(count.values()), len(count)
    for r in context_tree.op3_context_tree(spark, SF).collect():
        own = [*words(dict(rows)[r["doc_id"]]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in count for w in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in own))
        assert r["score"] < 0


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(1, "abracadabra alakazam")], "doc_id bigint, text string")
    counts = ngrams.counted(df.withColumn("t", F.lit(True)), context_tree.DEPTH, "text", "t", True)
    every = counts.select(F.explode(F.expr("transform(sequence(0L, 255L), b -> shiftright(gram, 8) * 256 + b)")).alias("gram")).distinct().join(counts, "gram", "left").select("gram", F.coalesce("n", F.lit(0)).alias("n"), F.lit(False).alias("often"))
    sums = context_tree.gram_values(every, 4).groupBy(F.shiftright("gram", 8)).agg(F.sum(F.pow(10.0, "value")).alias("s")).collect()
    assert len(sums) > 5 and all(r["s"] == pytest.approx(1, abs=1e-4) for r in sums)


def test_score_odd_rows(odd, empty):
    found = context_tree.scored(odd).collect()
    assert len(found) == odd.count() and {r["n_tokens"] for r in found if r["doc_id"] in (3, 4, 5)} == {1}
    assert context_tree.scored(empty).count() == 0


# Kneser-Ney


def test_kneser_ney_sums_to_one_and_both_paths_agree(spark, documents, labels):
    docs = documents.limit(30).select("doc_id", "text").withColumn("t", F.lit(True))
    counts = ngrams.counted(docs, perplexity.DEPTH, "text", "t", False)
    contexts = counts.where("n > 3").limit(5).select(F.shiftright("gram", 8).alias("c"))
    every = contexts.select(F.explode(F.expr("transform(sequence(0L, 255L), b -> c * 256 + b)")).alias("gram")).distinct()
    full = counts.join(every, "gram", "full_outer").select("gram", F.coalesce("n", F.lit(0)).alias("n"))
    table = common.checkpointed(perplexity.kneser_ney(full))
    sums = table.join(every, "gram", "left_semi").groupBy(F.shiftright("gram", 8)).agg(F.sum(F.pow(10.0, "value")).alias("s")).collect()
    assert sums and all(r["s"] == pytest.approx(1, abs=1e-6) for r in sums)
    near = [{r["doc_id"]: (r["__sum"], r["__grams"]) for r in ngrams.summed(docs, table, perplexity.DEPTH, "doc_id", "text", False, broadcast_rows=n).collect()} for n in (10**7, 0)]
    assert near[0] == near[1] and len(near[0]) == 30  # the same numbers, broadcast or joined


def test_quality_query_rejects_junk_and_keeps_clean(spark):
    truth = {r["doc_id"]: r["quality"] for r in common.read_table(spark, "/root/testdata/sf0.01", "labels").collect()}
    kept = {r["doc_id"]: r["kept"] for r in perplexity.op9_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    assert np.mean([kept[i] for i, q in truth.items() if q == 1]) > 0.99 and np.mean([kept[i] for i, q in truth.items() if q == 0]) < 0.2


def test_limits_come_from_all_trusted_rows(spark):
    n, rare = 60_000, 120  # beyond any bound that was, and a language with few of them
    lang = F.when(F.col("doc_id") % (n // rare) == 0, "xx").otherwise("en")
    word = F.when(lang == "xx", F.hex(F.xxhash64("doc_id"))).otherwise(F.concat(F.lit("plain words "), (F.col("doc_id") % 97).cast("string")))
    docs = spark.range(n).withColumnRenamed("id", "doc_id").select("doc_id", word.alias("text"), lang.alias("lang"))
    rows = perplexity.judged(docs, docs.select("doc_id", F.lit(1).alias("quality"))).select("doc_id", "lang", "__loss", "__grams", "__limit").collect()
    for own in ("xx", "en"):
        held = collections.defaultdict(list)
        for r in rows:
            if r["lang"] == own and crc(r["doc_id"]) == 0:
                held[min(8, max(2, int(math.log(r["__grams"], 4) + 1e-9)))].append(r["__loss"])
        limit = {k: sorted(x)[math.ceil(perplexity.QUANTILE * len(x)) - 1] * perplexity.SLACK for k, x in held.items() if len(x) >= perplexity.LEAST_ROWS}
        found = [(r["__limit"], limit[k] * (1 + perplexity.SHORT_SLACK / r["__grams"])) for r in rows if r["lang"] == own and (k := min(8, max(2, int(math.log(r["__grams"], 4) + 1e-9)))) in limit]
        assert found and all(x == pytest.approx(y) for x, y in found)


def test_quality_odd_rows(odd, empty, labels):
    out = perplexity.judged(odd, labels)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert perplexity.judged(empty, labels).count() == 0 and perplexity.judged(odd, labels.limit(0)).where("__kept").count() == odd.count()


# quality rules


def brute_measures(text):
    w = words_raw = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]:
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, words_raw)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_rules_query(spark, documents, odd, empty):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in quality_rules.op6_quality_rules(spark, SF).collect():
        m = brute_measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        assert r["base_failed"] == (m[0] < 20 or 100 * m[4] > 30 * m[0]) and r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
    found = quality_rules.judged(odd).collect()
    assert len(found) == odd.count() and all(r["base_failed"] for r in found if r["doc_id"] in (3, 4, 5, 6)) and quality_rules.judged(empty).count() == 0


def test_em_recovers_accuracies():
    rnd = np.random.default_rng(0)
    good, right = rnd.random(20000) < 0.85, np.linspace(0.75, 0.97, len(quality_rules.RULES))
    votes = np.where(rnd.random((20000, len(right))) < right, good[:, None], ~good[:, None]).astype(int)
    votes[rnd.random(votes.shape) < 0.2] = quality_rules.ABSTAIN
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, chance, prior = quality_rules.fitted(patterns, counts.astype(float))
    assert abs(prior - 0.85) < 0.03 and ((post[inverse.ravel()] > 0.5) == good).mean() > 0.98
    assert np.abs(chance[1, :, 1] - right).max() < 0.03


# language, toxicity


def test_language_query(spark, documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = [r for r in language_id.op7_language_id(spark, SF).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.97 and all(crc(r["doc_id"]) == 0 for r in rows)


def test_mixed_text_has_spans(spark, documents):
    model = language_id.learned(documents)
    by = {r["lang"]: r["text"].split() for r in documents.where("length(text) > 3000").collect()}
    text = " ".join(by["en"][:60] + by["de"][:40] + by["en"][60:90])
    row = language_id.identified(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de", "en"] and row["lang_pred"] == "en"
    assert abs(row["spans"][1]["first"] - 60) <= 3 and abs(row["spans"][1]["words"] - 40) <= 6


def test_languages_of_unlisted_scripts(spark):
    rnd, rows = np.random.default_rng(2), []
    for lang, first, n in (("en", 0x61, 26), ("gu", 0xA95, 20), ("te", 0xC15, 20), ("am", 0x1208, 60), ("ff", 0x1E922, 30), ("te2", 0xC15, 20)):
        vocabulary = ["".join(chr(first + int(c)) for c in rnd.integers(0, n, rnd.integers(3, 7))) for _ in range(60)]
        rows += [(len(rows) + i, lang, " ".join(rnd.choice(vocabulary, 25))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    model = language_id.learned(docs.where("doc_id % 4 <> 0"))
    found = {r["doc_id"]: r for r in language_id.identified(docs.where("doc_id % 4 = 0"), model).collect()}
    assert len(found) == 30 and all(found[i]["lang_pred"] == lang for i, lang, _ in rows if i in found)
    mixed = language_id.identified(spark.createDataFrame([(1, rows[0][2] + " 42 -- " + rows[45][2])], "doc_id bigint, text string"), model).first()
    assert {s["lang"] for s in mixed["spans"]} == {"en", "te"} and 0.4 < mixed["score"] < 0.6


def test_trigram_scores_equal_brute_force(spark):
    rows = [(k, lang, t) for k, (lang, t) in enumerate([("en", "the cat and the dog"), ("de", "der hund und die katze"), ("en", "and then the end"), ("fr", "le chat et le chien")])]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    for cells in (language_id.CELLS, 3 * 4096):  # folded to 4,096 buckets
        langs, logp, allowed = language_id.learned(docs, cells=cells)
        buckets = len(logp)
        assert langs == ["de", "en", "fr"] and buckets == min(language_id.BUCKETS, cells // 3) and allowed.shape == (language_id.N_SCRIPTS, 3)

        def bucket(tri):
            h = 0
            for c, m in zip(tri, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=True):
                h ^= ord(c) * m & 0xFFFFFFFF
            return (h >> 16) % buckets  # noqa: B023

        count = collections.defaultdict(collections.Counter)
        for _, lang, t in rows:
            padded = f" {t} "
            count[lang].update(bucket(padded[i - 1 : i + 2]) for i in range(1, len(padded) - 1) if padded[i] != " ")
        for k, lang in enumerate(langs):
            total = sum(count[lang].values())
            want = np.log((np.array([count[lang][b] for b in range(buckets)]) + 0.1) / (total + 0.1 * buckets))
            assert np.allclose(logp[:, k], want, atol=1e-5)


def test_more_languages_than_the_table_holds_at_full_size(spark):
    rnd, rows = np.random.default_rng(5), []
    for k in range(450):
        own = ["".join(chr(97 + int(c)) for c in rnd.integers(0, 26, 6)) for _ in range(12)]
        rows += [(k * 3 + i, f"l{k:03d}", " ".join(rnd.permutation(own))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    model = language_id.learned(docs.where("doc_id % 3 <> 0"))
    assert model[1].size <= language_id.CELLS
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identified(docs.where("doc_id % 3 = 0"), model).collect()}
    assert np.mean([found[i] == lang for i, lang, _ in rows if i % 3 == 0]) > 0.95


def test_viterbi_equals_brute_force():
    rnd = np.random.default_rng(3)
    sizes = np.array([3, 0, 5, 1])
    scores = rnd.normal(size=(9, 3)) * 4
    path, at = language_id.viterbi(scores, sizes, 2.5), 0
    for n in sizes:
        own, best = scores[at : at + n], None
        for combo in np.ndindex(*([3] * n)):
            value = sum(own[i, c] for i, c in enumerate(combo)) - 2.5 * sum(a != b for a, b in zip(combo, combo[1:], strict=False))
            best = max(best or (-1e9, ()), (value, combo))
        assert tuple(path[at : at + n]) == (best[1] if n else ())
        at += n


def test_language_odd_rows(odd, empty):
    model = language_id.learned(odd.where("lang IS NOT NULL"))
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identified(odd, model).collect()}
    assert [found[i] for i in (3, 4, 5, 8)] == ["und"] * 4 and found[7] == "ru" and found[1] == "en"
    assert language_id.identified(odd, language_id.learned(empty)).where("lang_pred <> 'und'").count() == 0


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in common.read_table(spark, sf, "labels").collect()}
    rows = [r for r in toxicity.op8_toxicity(spark, sf).collect() if r["doc_id"] in truth]
    assert all(r["held_out"] == (crc(r["doc_id"]) == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == 0 for r in held if truth[r["doc_id"]] == 0]) > 0.98
    assert np.mean([r["predicted"] for r in held if truth[r["doc_id"]] == 1]) > 0.5  # few labels at this size, see README


def brute_matches(lexicon, text):
    """Every pattern looked for at every place, exceptions first."""
    fold = {k: v for k, v in toxicity.LOOKALIKES.items()}
    plain = " " + " ".join(re.findall(r"[^\W_]+", "".join(fold.get(c, c) for c in (text or "").lower()))) + " "
    at = lambda p: [(i, i + len(p) - 1) for i in range(len(plain)) if plain.startswith(p, i)]
    spared = [x for e in toxicity.EXCEPTIONS for x in at(toxicity.folded(e))]
    hits = [(w, a, b) for p, w in lexicon.items() for a, b in at(p) if not any(x <= a and b <= y for x, y in spared)]
    return sum(w for w, _, _ in hits), len(hits)


def test_matches_equal_brute_force():
    lexicon, rnd = toxicity.chosen([(" fool", 5, 2.7), ("  no", 3, 1.0)]), np.random.default_rng(9)
    found = toxicity.automaton(lexicon)
    parts = ["idiot", "1d10t", "IDIOT!", "clown", "class clown", "trash", "trash can", "can", "foolish", "fool", "fo0l", "a", "nice", "scum", "soap scum", "scum soap", "_scum_", "\u0456diot", "", "..."]
    for _ in range(300):
        text = " ".join(rnd.choice(parts, rnd.integers(0, 12)))
        weight, n, _ = toxicity.matches(found, text)
        assert (pytest.approx(weight), n) == brute_matches(lexicon, text)


def test_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id bigint, toxic int")
    assert toxicity.sampled(docs, labels, "doc_id", "text", "toxic", 10, 10).count() == 3


def test_disguises_and_exceptions():
    found = toxicity.automaton(toxicity.chosen([]))
    hits = lambda t: toxicity.matches(found, t)[1]
    assert hits("you 1d10t!") == hits("an іdiot") == hits("IDIOT, idiot.") - 1 == 1
    assert hits("a clown fish in the trash can") == 0 and hits("idiotic clowns") == 0 and hits(None) == 0
    assert 0 <= toxicity.score(toxicity.DEFAULT_CURVE, 0.0, 0) < 0.5 <= toxicity.score(toxicity.DEFAULT_CURVE, 3.0, 10) <= 1


def test_many_exceptions_are_exact_and_quick():
    found = toxicity.automaton({" trash ": 3.0, " idiot ": 2.0})
    text = "trash can trash idiot proof idiot " * 30_000
    assert toxicity.matches(found, text) == (5.0 * 30_000, 60_000, 180_000)


def test_toxicity_odd_rows(odd, empty, labels):
    model = toxicity.trained(odd, labels)
    assert toxicity.scored(odd, model).where("score BETWEEN 0 AND 1").count() == odd.count()
    assert toxicity.scored(empty, model).count() == 0 and toxicity.kept(odd, model).columns == odd.columns


# pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.read_table(spark, sf, "documents")
    first = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf).select("doc_id").collect()}
    assert first == {r["doc_id"] for r in perplexity.op9_quality_classifier(spark, sf).where("kept").collect()}
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.written(stage(spark, step, sf))
        assert kept.columns == docs.columns and 0 < kept.count() < step.count()
        step = kept
    from tokenizers import Tokenizer

    rows = corpus_pipeline.STAGES[-1][1](spark, step, sf).collect()
    verify_packing(rows, {r["doc_id"]: r["text"] for r in step.collect()}, Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json")))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "simhash near-dedup", "packing"] and packing.TIERS[0] == 2048


def test_pipeline_odd_rows(spark, odd, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, empty):
        step = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = common.written(stage(spark, step, str(tmp_path)))
            assert step.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, step, str(tmp_path)).count() >= step.count()
