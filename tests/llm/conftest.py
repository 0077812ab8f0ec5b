import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon".split()
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, bucket int, size string, id int, fp int"


def words(seed, n):
    """n words that follow from the seed."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x >> 16 & 15] + (WORDS[x >> 8 & 15] if x & 64 else ""))
    return out


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and long texts, repeated rows, ties, and columns named like those made inside."""
    long = " ".join(words(1, 9000))
    rows = [(i, " ".join(words(i, 40 + i)) + "\nshared line of the site\n", "en", f"s{i % 2}", 1) for i in range(24)]
    rows += [(100, None, "en", "s0", None), (101, "", "en", "s0", 0), (102, " \t\n ", None, None, 3), (None, "Alpha beta", "en", "s1", 2)]
    rows += [(103, long, "en", "s0", len(long)), (104, "one", "en", "s0", 3), (105, "one", "en", None, 3), (2**60 + 1, "two\x00 three", "en", "s1", 1)]
    rows += [rows[3], rows[3], (None, None, None, None, None), (None, None, None, None, None)]
    return [(*r, "x", 7, "y", 9, 8) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
