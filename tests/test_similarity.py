import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import similarity as sim

AB = st.text(alphabet="abc ", max_size=9)


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def best_window(a, b):
    """The best ratio of the shorter text and any run of at most as many characters at an end of the longer,
    or of just as many inside it; texts of one length take either part."""
    if not a or not b:
        return 100.0 if a == b else 0.0

    def ratio(x, y):
        return 200.0 * lcs(x, y) / (len(x) + len(y))

    def over(x, y):
        runs = {y[i:j] for i in range(len(y)) for j in range(i + 1, len(y) + 1)}
        return max(ratio(x, r) for r in runs if len(r) == len(x) or len(r) < len(x) and (y.startswith(r) or y.endswith(r)))

    return max(over(x, y) for x, y in ((a, b), (b, a)) if len(x) <= len(y))


@given(AB, AB)
@settings(max_examples=300)
def test_common_subsequence(a, b):
    assert sim.common_subsequence(a, b) == lcs(a, b)
    assert sim.indel(a, b) == sim.indel(b, a)
    assert sim.partial(a, b) == pytest.approx(best_window(a, b))
    assert sim.token_set(a, b) == pytest.approx(sim.token_set(b, a))


@pytest.mark.parametrize(("f", "a", "b", "want"), [
    (sim.indel, "kitten", "sitting", 200 * 4 / 13), (sim.indel, "", "", 100), (sim.indel, "a", "", 0), (sim.token_set, "new york mets", "mets york new", 100), (sim.token_set, "a b", "a c", 200 / 3),
    (sim.token_set, "abc", "abc def", 100), (sim.token_set, "", "a", 0), (sim.partial, "abc", "xxabcyy", 100), (sim.partial, "", "a", 0), (sim.partial, "ab", "xa", 200 / 3),
    (sim.jaro_winkler, "martha", "marhta", 0.961111), (sim.jaro_winkler, "dixon", "dicksonx", 0.813333), (sim.jaro_winkler, "", "", 1), (sim.jaro_winkler, "a", "b", 0),
])
def test_goldens(f, a, b, want):
    assert f(a, b) == pytest.approx(want, abs=1e-5)


def test_numbers(spark):
    rows = [("12 400 411001", "12 500 411001", "studio 54", "studio 55"), ("12 411001", "12", "", ""), ("", "", "", ""), ("7 7", "8", "a1b2", "a1")]
    df = spark.createDataFrame(rows, "a string, b string, na string, nb string")
    c = {k: F.col(k) for k in ("a", "b", "na", "nb")}
    out = df.select(*[v.alias(k) for k, v in (sim.digit_features(c["a"], c["b"]) | sim.number_features(c["a"], c["b"], c["na"], c["nb"])).items()]).collect()
    assert (out[0].num_conflict, out[0].num_conflict_len, out[0].name_num_conflict, out[0].name_num_diff, out[0].house_state) == (1, 3, 1, 2, 1)
    assert (out[1].num_conflict, out[1].num_only_s1, out[1].num_conflict_len) == (0, 1, 0)
    assert (out[2].digit_jacc, out[2].house_state, out[2].n_digits_s1) == (0, 0, 0)
    assert (out[3].house_state, out[3].n_digits_s1, out[3].num_only_s1, out[3].name_num_diff) == (-1, 2, 1, 1)


def test_string_block(spark):
    from kinfold.functions.text import normalized

    rows = [("1", "Café Paris Ltd", "12 Rue A", "FR")]
    df = normalized(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"))
    a, b = (df.select(*[F.col(c).alias(p + c) for c in df.columns]) for p in ("a_", "b_"))
    r = a.crossJoin(b).select(*[v.alias(k) for k, v in sim.string_block().items()]).first()
    assert r.name_ratio == r.addr_tset == r.name_partial == 100 and r.name_jw == 1 and r.house_state == 1 and r.rec_addr_empty == 0
