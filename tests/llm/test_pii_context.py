import pytest

from quarryscan.llm import pii

CASES = [
    ("SSN: 123-45-6789, 234-56-7890", "SSN: [SSN], [SSN]"),
    ("SSN: 123-45-6789 234-56-7890 " + "x" * 40 + " 345-67-8901", "SSN: [SSN] [SSN] " + "x" * 40 + " 345-67-8901"),
    ("pay DE89 3704 0044 0532 0130 00 EUR 100", "pay [IBAN] EUR 100"),
    ("NO9386011117947 NOK 5, GB82WEST12345698765432 GBP", "[IBAN] NOK 5, [IBAN] GBP"),
    ("DE89 3704 0044 0532 0130 01 EUR 100", "DE89 3704 0044 0532 0130 01 EUR 100"),
]


def test_lists_of_numbers_and_ibans_before_capitals(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()} == {i: w for i, (_, w) in enumerate(CASES)}
    for r in pii.find(docs).collect():
        assert len(r["spans"]) == CASES[r["doc_id"]][1].count("[")


@pytest.mark.parametrize("gap", range(0, 45, 4))
def test_context_is_the_whole_texts(spark, gap):
    text = "tax" + "." * gap + " 12 34 56-78 +12 3 " + "." * 3 + " 234-56-7890 12 345-67-8901"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = [s["start"] for s in pii.find(docs).first()["spans"] if s["kind"] == "ssn"]
    assert got == [a for a in (text.index("234-"), text.index("345-")) if "tax" in text[max(0, a - 40) : a]]
