from feedloom.llm import decontaminate
from tests.llm.samples import ODD_TEXTS, documents, prose

QUESTION = ("A farmer named Alice has 12 apples and gives 5 apples to her neighbour Bob who walks 3 km to the market "
            "where he sells them again for money")
CHANGED = ("A farmer named Carol has 40 apples and gives 7 apples to her neighbour Dan who walks 9 km to the market "
           "where he sells them again for money")
TWICE = "If Alice pays 5 coins for bread then Alice has 5 coins left to buy cheese and some wine for dinner"
BROKEN = "If Carol pays 7 coins for bread then Dave has 9 coins left to buy cheese and some wine for dinner"
RENAMED = "If Carol pays 7 coins for bread then Carol has 7 coins left to buy cheese and some wine for dinner"


def items(spark, texts):
    return spark.createDataFrame(texts, "item_id long, text string")


def found(spark, texts, benchmark, **kw):
    rows = decontaminate.contaminated(documents(spark, texts, ("item_id", "hash", "position")),
                                      items(spark, benchmark), **kw).collect()
    return {(r.doc_id, r.item_id): r.changed_slots for r in rows}


def test_copies_and_reparameterised_questions(spark):
    before, after = prose(1, 80), prose(2, 80)
    texts = [(1, f"{before} {QUESTION}. {after}"), (2, f"{before}. {CHANGED.upper()[:1] + CHANGED[1:]} {after}"),
             (3, f"{before} {after}"), (4, f"{before}. {BROKEN}. {after}"), (5, f"{before}. {RENAMED}. {after}"),
             (6, " ".join(QUESTION.split()[:9]) + " " + after), (7, QUESTION.replace(" ", "  ").replace("has", "has,"))]
    out = found(spark, texts, [(10, QUESTION), (11, TWICE), (12, None), (13, "too short"), (None, QUESTION)])
    assert set(out) == {(1, 10), (2, 10), (5, 11), (7, 10)}
    assert out[1, 10] == 0 and out[7, 10] == 0 and out[2, 10] == 5 and out[5, 11] == 2


def test_rejected_documents_go_others_stay(spark):
    texts = ODD_TEXTS + [(30, prose(3, 50) + ". " + TWICE)]
    docs = documents(spark, texts, ("matched",))
    out = decontaminate.without_contaminated(docs, items(spark, [(1, TWICE)]))
    assert out.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(str(i) for i, _ in ODD_TEXTS)


def test_empty_tables(spark):
    assert found(spark, [], [(1, QUESTION)]) == {}
    assert found(spark, [(1, QUESTION)], []) == {}


def test_every_planted_passage_is_found(spark):
    benchmark = [(k, prose(1000 + k, 20 + k)) for k in range(30)]
    texts = [(k, prose(k, 100) + " " + benchmark[k % 30][1] + " " + prose(500 + k, 60)) for k in range(60)]
    clean = [(100 + k, prose(2000 + k, 150)) for k in range(40)]
    out = found(spark, texts + clean, benchmark)
    assert set(out) == {(k, k % 30) for k in range(60)}


def test_partly_changed_dense_short_and_shifted_items(spark):
    long = prose(3001, 20).replace(".", "") + " paid Alice then " + prose(3002, 20).replace(".", "") + " asked Alice again"
    numbers = "12 45 7 88 901 3 64 5 17 29 33 41 56 72 90"
    few = "purple Alice sings over quiet rivers"
    shifted = "then farmer Mary walks slowly along green river banks near old stone mills today"
    three = "rent 3 pays 4 " + prose(3003, 16).replace(".", "")
    rest = lambda k: prose(4000 + k, 40)
    texts = [(1, f"{rest(1)} {long.replace('Alice', 'Bob', 1)} {rest(2)}"), (2, f"{rest(3)} {numbers} {rest(4)}"),
             (3, f"{rest(5)} {few} {rest(6)}"), (4, f"{rest(7)} {shifted.replace('Mary', 'Mary Ann')} {rest(8)}"),
             (5, f"{rest(9)} {three.replace('3', '5', 1).replace('4', '5', 1)} {rest(10)}"), (6, rest(11)),
             (7, f"{rest(12)} {numbers.replace('7 88', '8 87').replace('17 29', '18 92')} {rest(13)}")]
    out = found(spark, texts, [(1, long), (2, numbers), (3, few), (4, shifted), (5, three)])
    assert set(out) == {(k, k) for k in range(1, 6)}
