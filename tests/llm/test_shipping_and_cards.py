"""What travels to workers, and card numbers that something follows."""

import pickle

import pytest

from lettermill.llm import decontamination, lang_id, pii


def test_broadcasts_hold_plain_data(spark, monkeypatch):
    """A broadcast is pickled by reference: a class of the package in it would ask workers for an installed copy."""
    sent = []
    plain = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(pickle.dumps(value)) or plain(value))
    docs = spark.createDataFrame([(i, f"{'the words of' if i % 2 else 'les mots de la'} text {i} " * 9, "en" if i % 2 else "fr") for i in range(60)], "doc_id long, text string, lang string")
    model = lang_id.train_on_rest(docs)
    assert {(r.lang, r.lang_pred) for r in lang_id.predict(docs, model).collect()} == {("en", "en"), ("fr", "fr")}
    items = spark.createDataFrame([(1, "les mots de la text 4 les mots de la text 4")], "item_id long, text string")
    assert decontamination.find_leaks(docs, items).count() >= 1
    assert decontamination.drop_leaks(docs, items).count() < 60
    assert len(sent) >= 4 and not any(b"lettermill" in s for s in sent)


@pytest.mark.parametrize(
    ("text", "rest"),
    [
        ("Card 4111 1111 1111 1111 12/27", " 12/27"), ("Card 4111111111111111 123", " 123"), ("Card 4111-1111-1111-1111 12 27", " 12 27"),
        ("Card 4111 1111 1111 1111", ""), ("Card 3782 822463 10005 9999", " 9999"), ("4111 1111 1111 1111, and", ", and"),
    ],
)
def test_a_card_goes_and_what_follows_stays(spark, text, rest):
    row = pii.replace_pii(spark.createDataFrame([(text,)], "text string"), "key").first()
    digits = [c for c in text.removesuffix(rest) if c.isdigit()]
    new = [c for c in row.text.removesuffix(rest) if c.isdigit()]
    assert row.pii_count == 1 and row.text.endswith(rest) and len(row.text) == len(text) and new != digits
    doubled = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(new)))
    assert doubled % 10 == 0, "the surrogate is a valid card of the same form"
    shape = lambda t: "".join("0" if c.isdigit() else c for c in t)
    assert shape(row.text) == shape(text)


@pytest.mark.parametrize("text", ["4111 1111 1111 1112 12/27", "order 1234 5678 9012 3456 78", "41111111111111112222"])
def test_other_numbers_stay(spark, text):
    row = pii.replace_pii(spark.createDataFrame([(text,)], "text string"), "key").first()
    assert row.text == text and row.pii_count == 0
