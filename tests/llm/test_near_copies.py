import numpy as np


def brute(texts, similarity):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (len(a & b) / len(a | b) if a | b else 1) >= similarity and root[i] != root[j]:
                x, y = max(root[i], root[j]), min(root[i], root[j])
                root = [y if r == x else r for r in root]
    return root


def test_copies_down_to_four_fifths_go_and_others_stay(spark):
    import corpus_pipeline as C

    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = [None, "", "two words", "Two words", "one two three four five"]
    for _ in range(12):
        base = words(300)
        texts.append(" ".join(base))
        for edits in (1, 3, 5, 6, 12):  # similarities about 0.97, 0.90, 0.85, 0.82, 0.66
            w = list(base)
            for at in rng.choice(60, edits, replace=False) * 5:
                w[at] = "changed"
            texts.append(" ".join(w))
    family = words(300)
    texts += [" ".join(family[:280] + words(20 + k % 3)) for k in range(80)]  # a large group, all alike
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[5], "c"), (None, "nobody else", "c"), (7, texts[7], "c")], "doc_id long, text string, keys string")
    out = C.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(brute(texts, 0.8))) and ids.count(None) == 1
    assert C.near_copies(spark, docs.limit(0), "").count() == 0


def test_families_just_below_and_above_are_told_apart(spark):
    """80 documents of two families whose pairs are all near 0.8, so that many groups stay apart for several rounds."""
    import corpus_pipeline as C

    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = []
    for edits in (2, 3):  # pairs share all but 10 x edits of 200 shingles or so: similarities about 0.82 and 0.74
        base = words(200)
        for _ in range(40):
            w = list(base)
            for at in rng.choice(38, edits, replace=False) * 5 + 4:
                w[at] = f"new{rng.integers(0, 10**9)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in C.near_copies(spark, docs, "").collect())
    want = sorted(set(brute(texts, 0.8)))
    assert len(want) > 3 and set(want) <= set(got) and len(got) <= len(want) + 2


def test_signatures_decide_as_the_sets_do():
    """Of pairs at the similarity, and as far from it as SURE asks, the signature's verdict is the sets' in all but one in a thousand."""
    from phasegrid.llm import near_copies as N

    rng = np.random.default_rng(3)
    wrong = 0
    for similarity in (0.8, 0.82, 0.9, 0.79, 0.7):
        for _ in range(200):
            n = int(rng.integers(60, 400))
            both = round(2 * n * similarity / (1 + similarity))
            x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = np.unique(x[:n]), np.unique(np.r_[x[:both], x[n:]])
            guess, true = (N.signature(a) == N.signature(b)).mean(), N.jaccard(a, b)
            wrong += guess <= N.SIMILARITY - N.SURE and true >= N.SIMILARITY or guess >= N.SIMILARITY + N.SURE and true < N.SIMILARITY
    assert wrong <= 1


def test_bands_bring_pairs_at_the_similarity_together():
    from phasegrid.llm import near_copies as N

    rng, met = np.random.default_rng(4), 0
    for _ in range(300):
        n = 200
        both = round(2 * n * 0.8 / 1.8)
        x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        met += bool(set(N.keys(N.signature(np.unique(x[:n])))) & set(N.keys(N.signature(np.unique(np.r_[x[:both], x[n:]])))))
    assert met >= 295


def test_edited_copies_too_far_from_each_other_do_not_all_meet(spark, monkeypatch):
    """240 documents of one text with 0 to 8 edits: those with few are one component, the others, alike to none, aren't compared with all."""
    import corpus_pipeline as C
    from phasegrid.llm import near_copies as N

    met, alike = [], N._alike

    def counted(pairs, sets, similarity):
        met.append(pairs.count())
        return alike(pairs, sets, similarity)

    monkeypatch.setattr(N, "_alike", counted)
    rng = np.random.default_rng(8)
    base, texts = [f"w{x}" for x in rng.integers(0, 5000, 150)], []
    for i in range(240):
        w = list(base)
        for at in rng.choice(29, i % 9, replace=False) * 5 + 2:
            w[at] = f"new{rng.integers(0, 10**9)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in C.near_copies(spark, docs, "").collect())
    assert got == sorted(set(brute(texts, 0.8))) and len(got) > 100
    assert sum(met) < 12 * len(texts)


def test_a_family_is_bounded_once_and_compared_in_few_rounds(spark, monkeypatch):
    """Bands that share a family measure it from one head, so what sets its members apart is listed once; and no pair of a family is compared twice in a round."""
    import corpus_pipeline as C
    from phasegrid.llm import near_copies as N

    apart, rounds, alike, bounds = [], [], N._alike, N._bounds

    def counted(pairs, sets, similarity):
        rounds.append((pairs.count(), pairs.distinct().count()))
        return alike(pairs, sets, similarity)

    def listed(groups, sets, similarity):
        large = groups.groupBy("key").count().where(f"count > {N.BOUNDED}")
        apart.append((groups.join(large, "key").select("head", "node").distinct().count(), groups.join(large, "key").select("node").distinct().count()))
        return bounds(groups, sets, similarity)

    monkeypatch.setattr(N, "_alike", counted)
    monkeypatch.setattr(N, "_bounds", listed)
    rng = np.random.default_rng(9)
    base, texts = [f"w{x}" for x in rng.integers(0, 5000, 150)], []
    for i in range(300):
        w = list(base)
        for at in rng.choice(29, 2 + i % 5, replace=False) * 5 + 2:
            w[at] = f"new{rng.integers(0, 10**9)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in C.near_copies(spark, docs, "").collect())
    assert got == sorted(set(brute(texts, 0.8)))
    assert len(apart) == 1 and apart[0][0] <= 1.1 * apart[0][1]
    assert all(n == distinct for n, distinct in rounds) and len(rounds) <= 4
