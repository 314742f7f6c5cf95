import random

import xxhash

from particula.llm import simhash


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]


def _print_of(text, n=3):
    w = _words(text)
    if not w:
        return 0
    grams = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, n=3, radius=2):
    prints = [_print_of(t, n) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], f"{prints[i]:016x}", min(groups[find(i)])) for i in range(len(rows)))


def _rows(seed=1):
    r = random.Random(seed)
    vocab = ["Alpha", "béta", "gamma", "delta", "x", "ÄB", "of", "the"]
    out = []
    for _ in range(60):
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 60, 200]))]
        for _ in range(r.randint(1, 4)):
            w = list(base)
            if r.random() < 0.6:
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(r.choice([" ", "\n", "  \t"]).join(w))
    out += ["", None, "   \n", " ", " a b", "a " * 30000, "word" * 20000]
    r.shuffle(out)
    return list(enumerate(out))


def test_near_duplicates_match_brute_force(spark):
    rows = _rows()
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    assert got == want
    # blocks of split keys give the same links
    assert sorted(map(tuple, simhash.near_duplicates(df, hot_rows=3).collect())) == want


def test_dense_group_is_linked_through_tiles(spark):
    r = random.Random(3)
    fps = sorted({sum(1 << b for b in r.sample(range(24), r.randint(0, 8))) for _ in range(1500)})
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "fp long, node long")
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    want = sorted((i, find(i)) for i in range(len(fps)) if sum(find(j) == find(i) for j in range(len(fps))) > 1)
    for hot in (100, 16384):
        links = simhash.near_links(df, 2, hot)
        got = simhash.components(links).select("node", "component").collect()
        assert sorted(map(tuple, got)) == want


def test_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, key long, fp string")
    assert simhash.near_duplicates(empty).collect() == []
    same = spark.createDataFrame([(7, "a b c d", 1, "x"), (7, "a b c d", 2, "y"), (3, "A  B c D", None, None), (None, "q r s t u", 1, "z")], "doc_id long, text string, node long, fp string")
    got = sorted((map(tuple, simhash.near_duplicates(same).collect())), key=str)
    assert [(x[0], x[2]) for x in got] == [(3, 3), (7, 3), (7, 3), (None, None)]


def test_rows_that_share_an_id_alone_both_stay(spark):
    r = random.Random(9)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(4)]
    rows = [(1, texts[0], 1), (1, texts[1], 2), (1, texts[1].upper(), 3), (2, texts[1], 4), (2, texts[2], 5), (2, texts[2], 5), (None, texts[2], 6), (None, texts[3], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = [x.n for x in simhash.drop_near_duplicates(df).collect()]
    assert len(got) == 4 and {1, 5, 7} < set(got) and set(got) & {2, 3}


def test_one_row_of_each_component_stays(spark):
    rows = _rows(2)
    got = sorted(map(tuple, simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()))
    stays = {i for i, _, c in brute(rows) if i == c}
    assert got == [x for x in rows if x[0] in stays]
