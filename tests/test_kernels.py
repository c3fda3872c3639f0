import random

from ringloom.operators import kernels as K
from ringloom.operators.molecules import identities

rnd = random.Random(5)


def dna(n):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def noisy(s, p):
    return "".join(rnd.choice("ACGT") if rnd.random() < p else c for c in s if rnd.random() > p / 3)


def test_density_peak():
    assert K.density_peak([47, 48, 48, 49, 319, 319, 319, 324]) == 319


def test_consensus():
    assert K.consensus([]) == "" and K.consensus(["ACGT"]) == "ACGT"
    t = dna(120)
    assert K.consensus([t] * 3) == t
    assert K._edit(K.consensus([noisy(t, 0.06) for _ in range(9)]), t) <= 3


def test_graph_keeps_every_sequence():
    g, seqs = K.Graph(), [noisy(dna(40), 0.1) for _ in range(3)]
    for s in seqs:
        g.add(s)
        pairs = [x for _, x in g.align(s) if x >= 0]
        assert pairs == sorted(pairs) and len(pairs) == len(s)
    assert sum(len(p) for p in g.pred) == sum(len(p) for p in g.succ)


def test_pattern():
    u = "CTC" + "ACG" + "CA" + "TTT" + "CG" + "AAA" + "TA" + "GCG" + "GAG"
    (score, a, b), (low, _, _) = K.match_pattern(["TTTTT" + u + "ACGTA", dna(34)])
    assert (a, b) == (5, 29) and score > low


def test_umi_both_strands():
    anchor, u = dna(22), "CTCACGCATTTCGAAATAGCGGAG"
    read = dna(10) + anchor + u + dna(220)
    a, b = K.extract_umis(["x", "y"], [read, K.revcomp(read)], anchor)
    assert a[1:3] == ("+", u) and b[1:3] == ("-", u) and a[3] == b[3]
    assert K.extract_umis(["s"], ["ACGT"], anchor) == [] and K.extract_umis(["n"], [None], anchor) == []


def test_tandem():
    t = dna(150)
    seg, c = K.tandem_consensus(t * 4)
    assert len(c) == 150 and c in t * 2 and seg.count(";") >= 2
    assert K.tandem_consensus(dna(400)) is None and K.tandem_consensus("ACGT") is None


def test_mapping():
    t = dna(600)
    (q0, q1, t0, t1, strand, _), *_ = K.mapped(t[100:400], t)
    assert strand == "+" and t0 - q0 == 100 and t1 <= 400 and q1 - q0 > 200
    assert K.mapped(K.revcomp(t[100:400]), t)[0][4] == "-"
    assert K.maps_repeatedly(t[:300] * 3, t[:300]) and not K.maps_repeatedly(dna(300), t)


def test_identity():
    assert identities(["ACGTACGTACGT"], ["ACGTACGTACGT"])[0] == 1
    assert identities(["ACGTACGTACG"], ["ACGTACGTACGT"])[0] == 1  # contained
    assert identities(["ACGTACGTACGT"], ["ACGTTCGTACGT"])[0] < 0.98
