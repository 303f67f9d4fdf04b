"""Language model, toxicity and licence operators against brute force, held-out accuracy and planted cases."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import licenses, lm_scoring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score long, w string, n long"
EDGE = [(None, "no id here"), (7000, None), (7001, ""), (7002, " \n "), (7003, "the of and " * 40_000), (7004, "twice"), (7004, "twice")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    return table(spark, [(r.doc_id, r.text) for r in own] + EDGE)


CLASSES = 90


def network(rnd):
    p = lm_scoring.parameters(rnd.integers(1, 50, CLASSES).astype(float))
    return {k: v.astype(np.float64) for k, v in p.items()}


def test_gradients_match_differences():
    rnd = np.random.default_rng(0)
    p = network(rnd)
    row, places = lm_scoring.padded(rnd.integers(0, CLASSES, 30), np.array([10, 0, 20]), CLASSES)
    loss = lambda q: -lm_scoring.token_scores(q, row, places).mean()
    after = {k: v.copy() for k, v in p.items()}
    lm_scoring.train(after, row, places, rate=1.0)
    scale = min(1.0, len(places) / lm_scoring.BATCH)
    group, slot = divmod(int(row[places[0]]), p["leaf"].shape[2])
    for name, at in (("top_bias", (group,)), ("leaf_bias", (group, slot)), ("leaf", (group, 3, slot)), ("hidden", (2,)), ("top", (1, group)), ("embed", (1, int(row[places[4]]), 3))):
        up = {k: v.copy() for k, v in p.items()}
        up[name][at] += 1e-5
        slope = (loss(up) - loss(p)) / 1e-5
        step = (p[name][at] - after[name][at]) / scale / (4 if name == "embed" else 1)
        assert abs(step - slope) < 1e-3 * max(1, abs(slope)), name


def plain_log_probs(p, codes, pad):
    """Log-probability of each class of one text, token by token and without the order by groups."""
    size, out = p["leaf"].shape[2], []
    row = [pad, pad, *codes, pad, pad]
    for i, c in enumerate(codes):
        h = np.tanh(p["hidden"] + sum(p["embed"][k][row[i + 2 + o]] for k, o in enumerate(lm_scoring.OFFSETS)).astype(float))
        top, leaf = h @ p["top"] + p["top_bias"], h @ p["leaf"][c // size] + p["leaf_bias"][c // size]
        out.append(top[c // size] - np.log(np.exp(top).sum()) + leaf[c % size] - np.log(np.exp(leaf).sum()))
    return out


def test_probabilities_sum_to_one():
    rnd = np.random.default_rng(5)
    p = network(rnd)
    texts = [[int(x) for x in rnd.integers(0, CLASSES, 5)] for _ in range(3)]
    total = 0.0
    for c in range(CLASSES):
        total += np.exp(plain_log_probs(p, [*texts[0][:2], c, *texts[0][3:]], CLASSES)[2])
    assert abs(total - 1) < 1e-6
    row, places = lm_scoring.padded(np.array(sum(texts, [])), np.array([5, 5, 5]), CLASSES)
    want = [x for t in texts for x in plain_log_probs(p, t, CLASSES)]
    assert np.allclose(lm_scoring.token_scores(p, row, places), want)


def test_scores_equal_brute_force(spark, docs):
    """Every document's score from the fitted network and plain counts, word by word."""
    from collections import Counter

    fit = lm_scoring.fitted(docs)
    rows = docs.collect()
    split = lambda t: re.findall(lm_scoring.WORD, t or "")
    counts = Counter(w for r in rows for w in split(r.text))
    tokens = lm_scoring.Tokens(fit.top, len(fit.totals) - len(fit.top))
    inside = Counter()
    for w, n in counts.items():
        inside[tokens.of(w)] += n
    assert [inside[c] for c in range(len(fit.totals))] == fit.totals.tolist()
    got = {r.doc_id: r for r in lm_scoring.pseudo_likelihood(docs).collect()}
    for r in rows[:60]:
        words = split(r.text)[:4000]
        if len(words) == 4000 or r.doc_id is None:
            continue
        codes = [tokens.of(w) for w in words]
        want = sum(plain_log_probs(fit.model, codes, len(fit.totals))) + sum(np.log(counts[w] / inside[c]) for w, c in zip(words, codes, strict=True))
        assert abs(got[r.doc_id].log_prob - want) < 1e-3 * max(1, len(words)), r.doc_id


def test_training_beats_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    losses = lm_scoring.fitted(docs).losses
    # The start's biases are the classes' frequencies.
    assert losses[-1] < losses[0] - 0.2


def test_pseudo_likelihood(spark, docs):
    got = lm_scoring.pseudo_likelihood(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for i in (7000, 7001, 7002):
        assert by[i].n_tokens == 0 and by[i].log_prob == 0 and by[i].mean_log_prob is None
    assert by[7003].n_tokens == 120_000
    assert len({r.log_prob for r in got if r.doc_id == 7004}) == 1
    for r in got:
        if r.n_tokens:
            assert r.log_prob < 0 and abs(r.mean_log_prob * r.n_tokens - r.log_prob) < 1e-6 * abs(r.log_prob)
    assert lm_scoring.pseudo_likelihood(table(spark, [])).count() == 0


def test_rare_words_are_scored_by_their_counts(spark, monkeypatch):
    rows = [(i, "ab " * 50 + f"qqing{i % 2}xyz") for i in range(60)] + [(60, "ab " * 50 + "unseen1xyz")]
    rows += [(100 + i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(20)]
    by = {r.doc_id: r for r in lm_scoring.pseudo_likelihood(table(spark, rows)).collect()}
    assert len(by) == len(rows)
    # All of these end alike, so only the counts within the class, or a class of its own, tell 30 occurrences from one.
    assert by[0].log_prob > by[60].log_prob + 2
    monkeypatch.setattr(lm_scoring, "HEAD", 0)
    again = {r.doc_id: r for r in lm_scoring.pseudo_likelihood(table(spark, rows)).collect()}
    assert all(abs(again[k].log_prob - by[k].log_prob) < 1e-3 for k in by)


def test_scores_do_not_follow_the_file_layout(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, " ".join(f"a{k} b{k}" for k in rnd.integers(0, 30, 200))) for i in range(120)]
    docs = table(spark, rows)
    one, many = ({r.doc_id: r for r in lm_scoring.pseudo_likelihood(docs.repartition(n)).collect()} for n in (1, 12))
    assert all(abs(one[k].mean_log_prob - many[k].mean_log_prob) < 1e-3 for k in one)
    # Frequencies alone give log(1/60); every second word follows from its neighbour.
    assert np.mean([many[k].mean_log_prob for k in many]) > np.log(1 / 60) + 0.3


def test_vocabulary_follows_the_corpus():
    assert lm_scoring.classes_for(10**9)[0] > lm_scoring.classes_for(10**6)[0] > lm_scoring.classes_for(10)[0] - 1
    assert lm_scoring.classes_for(10**9)[1] > lm_scoring.classes_for(10**6)[1]


def test_training_beats_word_frequencies():
    rnd = np.random.default_rng(1)
    start = rnd.integers(0, 40, 4000)
    row, places = lm_scoring.padded(np.stack([start, start + 40], 1).ravel(), np.array([8000]), 80)
    p = lm_scoring.parameters(np.full(80, 100.0))
    before = lm_scoring.token_scores(p, row, places).mean()
    for _ in range(40):
        lm_scoring.train(p, row, places)
    assert lm_scoring.token_scores(p, row, places).mean() > before + 0.5


def test_word_counts(spark, docs):
    from collections import Counter

    want = Counter()
    for r in docs.collect():
        want.update(re.findall(lm_scoring.WORD, r.text or ""))
    assert {r.word: r.n for r in lm_scoring.word_counts(docs, "text").collect()} == dict(want)


@pytest.fixture(scope="module")
def letters():
    text = "  ".join(["you are an idiot and a loser", "stupid clown", "this is pathetic and worthless", "moron of the trash", "the scum is disgusting"] * 50)
    x = toxicity.letter_codes(f"  {text}  ")
    grams, counts = np.unique((x[:-2] * toxicity.LETTERS + x[1:-1]) * toxicity.LETTERS + x[2:], return_counts=True)
    return toxicity.trigram_model(grams, counts)


@pytest.mark.parametrize(
    ("noisy", "word"),
    [("1d10t", "idiot"), ("l0s3r", "loser"), ("stuuuupid", "stupid"), ("m.o.r.o.n", "moron"), ("cl*wn", "clown"), ("p@th3t1c", "pathetic"), ("tr4$h", "trash"), ("iiiddiioot", "idiot")],
)
def test_restore(letters, noisy, word):
    assert word in toxicity.restored_words(noisy, letters)


def test_restore_is_the_best_path(letters):
    import itertools

    for word in ("1d!0t", "sscuum", "l.0$er"):
        best = None
        for path in itertools.product(*toxicity.lattice(word)):
            text, cost, a, b = "".join(r for r, _ in path), sum(c for _, c in path), 0, 0
            for c in text:
                z = toxicity.CODE.get(c, toxicity.OTHER if c.isalpha() else 0)
                cost, a, b = cost - float(letters[a, b, z]), b, z
            best = min(filter(None, [best, (cost - float(letters[a, b, 0]), text)]))
        assert toxicity.restore(word, letters) == best[1]


def test_spaced_words_are_joined(letters):
    assert {"you", "idiot"} <= toxicity.words_of("you i d i o t", letters, {})


def test_long_tokens_and_runs_are_decoded_whole(letters):
    long = '{"a":"' + "x1/" * 30 + '","b":"1d10t"}'
    for token in (long, "dumb,1d10t", "https://example.org/some/very/long/path/to/a/page/1d10t?x=1"):
        assert "idiot" in toxicity.restored_words(token, letters), token
    for n in range(34, 44):
        run = " ".join(("you" * 20)[:n] + "idiot")
        assert any("idiot" in w for w in toxicity.words_of(run, letters, {})), n
    assert len(toxicity.restore("1d10t" * 4000, letters)) >= 4000


def test_toxicity_on_held_out_rows(spark):
    rnd = np.random.default_rng(2)
    calm = [f"w{chr(97 + i % 26)}rd{chr(97 + i // 26)}" for i in range(200)]
    rude = ["idiot", "moron", "clown", "scum"]
    rows, labels = [], []
    for i in range(600):
        words = [calm[k] for k in rnd.integers(0, 200, 60)]
        bad = i % 3 == 0
        if bad:
            words.insert(int(rnd.integers(0, 60)), rude[i % 4] if i % 2 else rude[i % 4].replace("o", "0"))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), 1))
    labels += [(None, 1, 0), (3, None, 0), (0, 1, 1)]
    truth = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(table(spark, rows + EDGE), truth).collect()
    assert len(got) == len(rows) + len(EDGE)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    # No labels, and no rows.
    none = toxicity.toxicity(table(spark, EDGE), truth.where("false")).collect()
    assert all(r.predicted == 0 for r in none) and len(none) == len(EDGE)
    assert toxicity.toxicity(table(spark, []), truth).count() == 0


def test_toxicity_scores_equal_brute_force(spark, docs, sf_dir):
    """Every score from the fitted models, restored word by restored word; repeated ids don't pass the bound of the fit."""
    truth = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, stems, weights, base = toxicity.fitted(docs, truth, "doc_id", "text", "toxic", 100)
    want = {}
    for r in docs.collect():
        words = toxicity.words_of(r.text or "", model, {})
        hit = {s for w in words for s in toxicity.stems_of(w) if s in stems}
        want[r.doc_id] = 1 / (1 + np.exp(-(base + sum(weights[stems[s]] for s in sorted(hit)))))
    got = toxicity.toxicity(docs, truth, labelled_rows=100).collect()
    assert all(abs(r.score - want[r.doc_id]) < 1e-9 for r in got)
    twice = docs.unionByName(docs).unionByName(docs)
    again = toxicity.fitted(twice, truth, "doc_id", "text", "toxic", 100)
    assert again[1].keys() == stems.keys() and np.allclose(again[2], weights)


def test_every_known_licence_has_an_anchor():
    texts = [t for _, t in licenses._notices() + licenses._texts()]
    assert len(licenses.known()) < 2000 and len(licenses.runs()) > 20
    for t in texts:
        assert set(" ".join(licenses.paragraphs(t)).split()) & set(licenses.ANCHORS), t
        assert licenses.units(t)[0][1] in {d for d, _, _ in licenses.known()}
    for word in licenses.ANCHORS:
        assert licenses.canonical(word) == word


def test_license_report(spark):
    mit = "MIT License\n\nCopyright (c) 2021 Somebody\n\n" + licenses.TEXTS["MIT"]
    rows = EDGE + [
        (1, "prose\nLicenced under the Apache License, version 2.0.\nmore"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, licenses.TEXTS["MIT"].upper().replace(",", " ,")),
        (4, mit),
        (5, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
        (6, "we licensed under the table something else"),
    ]
    got = {r.doc_id: r for r in licenses.license_report(table(spark, rows)).collect()}
    assert (got[1].licenses, got[1].whole, got[1].restricted) == ("Apache-2.0", None, False)
    assert (got[2].licenses, got[2].whole, got[2].restricted) == ("GPL-3.0", "GPL-3.0", True)
    assert got[3].whole == "MIT"
    assert got[4].licenses == "MIT"
    assert (got[5].licenses, got[5].n_notices, got[5].restricted) == ("CC-BY-NC-4.0,MIT", 2, True)
    assert got[6].licenses == "" and got[7000].n_notices == 0
    assert licenses.license_report(table(spark, rows)).count() == len(rows)
    assert licenses.license_report(table(spark, [])).count() == 0


def test_entire_texts_in_files(spark):
    """Standard files, with a title and a copyright line, with CRLF line ends, wrapped, and inside other text."""
    import textwrap

    mit = "MIT License\n\nCopyright (c) 2021 Somebody\n\n" + licenses.TEXTS["MIT"]
    wrapped = "\n\n".join(textwrap.fill(p, 70) for p in licenses.TEXTS["BSD-3-Clause"].split("\n\n"))
    apache = "/usr/share/common-licenses/Apache-2.0"
    rows = [
        (1, mit),
        (2, mit.replace("\n", "\r\n")),
        (3, f"Copyright 1999, Some One\nAll rights reserved.\n\n{wrapped}\n"),
        (4, f"Some words first.\n\n{licenses.TEXTS['MIT']}\n\nAnd some words after."),
        (5, f"// a program\n\n{licenses.TEXTS['Apache-2.0']}\n\nint main() {{}}"),
        (6, "MIT\nISC\nUnlicense"),
        (7, "The BSD-2-Clause text\n\n" + licenses.TEXTS["BSD-2-Clause"].replace("\n\n1.", "\n1.").replace("\n\n2.", "\n2.")),
        (8, licenses.TEXTS["MIT"].replace("sublicense", "sell")),
    ]
    got = {r.doc_id: r for r in licenses.license_report(table(spark, rows)).collect()}
    assert [got[i].whole for i in (1, 2, 3)] == ["MIT", "MIT", "BSD-3-Clause"]
    assert (got[4].whole, got[4].licenses) == (None, "MIT")
    assert (got[5].whole, got[5].licenses) == (None, "Apache-2.0")
    assert got[6].licenses == "" and got[7].licenses == "BSD-2-Clause" and got[8].licenses == ""
    import pathlib

    for name, licence in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        file = pathlib.Path(apache).with_name(name)
        if not file.exists():
            continue
        text = file.read_text(encoding="utf-8")
        table_of = {d: i for d, i, _ in licenses.known()}
        found = [(k, table_of.get(d)) for k, d in licenses.units(text)]
        assert (0, licence) in found, name
        inside = [table_of.get(d) for _, d in licenses.units(f"before\n\n{text}\n\nafter")]
        assert licence in inside, name


def test_license_report_equals_brute_force(spark, docs):
    known = {d: i for d, i, _ in licenses.known()}
    got = licenses.license_report(docs)
    want = {}
    for r in docs.collect():
        hits = {known.get(hashlib.sha256(" ".join(licenses.paragraphs(x)).encode()).hexdigest()) for x in [r.text or "", *(r.text or "").split("\n")]}
        want[r.doc_id] = hits - {None}
    for r in got.collect():
        assert want[r.doc_id] <= set(filter(None, r.licenses.split(",")))
    assert sum(bool(h) for h in want.values()) > 0
