import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from entwine.functions import similarity, text


def run(spark, make, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", make(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


CASES = [
    (text.normalize_text, ["", None, "  NaïVe  ", "Well, then...", "a_b", "½ ﬁx"], ["", "", "naive", "well then", "a_b", "12 fix"]),
    (text.normalize_business_name_advanced, ["R & D Works", "x&y", None], ["r and d works", "x and y", ""]),
    (text.business_name_core, ["north star trading ltd", "north star trading pvt ltd", "delta inc corp limited", "pear", "co", ""], ["north star trading"] * 2 + ["delta", "pear", "", ""]),
    (text.normalize_business_address, ["9 Elm St., Flat 2", "Hill Ave", "St Ann Rd"], ["9 elm street flat 2", "hill avenue", "street ann road"]),
    (text.postal_code, ["Mysore 570001 IN", "TX 73301-0001", "nothing", "1234567", None, "11111 22222"], ["570001", "73301", "", "", "", "22222"]),
    (text.numeric_tokens, ["5 Oak St, 73301", "none here", "7 7"], [["5", "73301"], [], ["7", "7"]]),
    (text.tokens, ["two words", ""], [["two", "words"], []]),
    (text.split_list, ["a,b", "a,,b", " ", None, ""], [["a", "b"], ["a", "b"], [], [], []]),
]


@pytest.mark.parametrize("make,values,wanted", CASES)
def test_cases(spark, make, values, wanted):
    assert run(spark, make, values) == wanted


def plain(s):
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s)).strip()


def test_random_strings_as_python_has_them(spark):
    draw = random.Random(7)
    alphabet = "aB1 2_-,.&éÜß½ﬁⅧ①٣５́‍\t\n中 stRdave"
    values = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(12))) for _ in range(3000)]
    assert run(spark, text.normalize_text, values) == [plain(v) for v in values]
    assert run(spark, text.postal_code, values) == [(re.findall(r"\b\d{5,6}\b", v) or [""])[-1] for v in values]
    assert run(spark, text.numeric_tokens, values) == [re.findall(r"\b\d+\b", v) for v in values]
    names = run(spark, text.normalize_business_name_advanced, values)
    assert run(spark, text.normalize_business_name_advanced, names) == names


def test_preprocess_keeps_raw_columns(spark):
    row = spark.createDataFrame([("S1-09", "Pear Corp.", "4 Orchard Walk, 73301", "USA", 1)], "entity_id string, business_name string, business_address string, country string, more int")
    got = text.preprocess(row).first()
    assert got["business_name"] == "Pear Corp." and got["more"] == 1
    assert (got["business_name_normalized"], got["business_name_core"], got["business_address_normalized"], got["business_address_postal"]) == ("pear corp", "pear", "4 orchard walk 73301", "73301")


def jaro_winkler(a, b):
    if not a or not b:
        return 0.0
    reach, used, hits = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            hits.append(c)
    if not hits:
        return 0.0
    m, turned = len(hits), sum(x != b[j] for x, j in zip(hits, sorted(used), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_jaro_winkler():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcd") for _ in range(draw.randrange(14)))
    left, right = [word() for _ in range(3000)], [word() for _ in range(3000)]
    got = similarity.jaro_winkler_many(left, right)
    assert got == pytest.approx([jaro_winkler(a, b) for a, b in zip(left, right, strict=True)], abs=1e-12)
    assert similarity.jaro_winkler_many(["harbour coffee"], ["zinc llp"])[0] < 0.5
    assert similarity.jaro_winkler_many(["harbour coffee"], ["harbor coffee"])[0] > 0.8
