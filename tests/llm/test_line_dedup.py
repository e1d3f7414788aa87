from collections import defaultdict

from feedloom.llm import line_dedup
from feedloom.llm.line_dedup import chunks_of
from tests.llm.samples import ODD_TEXTS, documents, prose


def test_chunks_cover_the_text():
    for text in (b"", b"a", b"a\nb\n", prose(1, 400).replace(".", "\n").encode()):
        chunks = chunks_of(text)
        assert b"\n".join(text[a:b] for a, b, _ in chunks) == text
        assert sum(n for _, _, n in chunks) == text.count(b"\n") + 1


def test_boundaries_resist_shifts():
    text = prose(2, 2000).replace(".", "\n").encode()
    before = {text[a:b] for a, b, _ in chunks_of(text)}
    shifted = b"a new line\n" + text
    after = {shifted[a:b] for a, b, _ in chunks_of(shifted)}
    assert len(before & after) >= len(before) - 2


def plain(texts):
    """The same decision by a dictionary of chunk bytes."""
    places = defaultdict(list)
    for i, text in texts:
        data = (text or "").encode()
        for k, chunk in enumerate(chunks_of(data)):
            if chunk[2] >= line_dedup.LEAST_LINES and chunk[1] - chunk[0] >= line_dedup.LEAST_BYTES:
                places[data[chunk[0]:chunk[1]]].append((i, k))
    gone = defaultdict(set)
    for at in places.values():
        for i, k in sorted(at)[1:]:
            gone[i].add(k)
    out = {}
    for i, text in texts:
        if gone[i]:
            data = text.encode()
            left = b"\n".join(data[a:b] for k, (a, b, _) in enumerate(chunks_of(data)) if k not in gone[i]).decode()
            if left.strip():
                out[i] = left
        else:
            out[i] = text
    return out


def test_repeats_go_and_first_places_stay(spark):
    passages = [prose(k, 60).replace(".", "\n") for k in range(6)]
    texts = [(n, "\n".join([prose(50 + n, 40).replace(".", "\n"), passages[n % 6], passages[n * 5 % 6],
                            prose(90 + n, 40).replace(".", "\n")])) for n in range(24)]
    texts += [(40, texts[3][1]), (41, texts[3][1]), (42, None), (43, "")]
    out = {r.doc_id: r.text for r in line_dedup.without_repeats(documents(spark, texts)).collect()}
    want = plain(texts)
    assert out == want and any(want[i] != t for i, t in texts if i in want)


def test_odd_rows(spark):
    two = "the same line that is long enough to count as one\nand another line after it that is long too\n"
    texts = ODD_TEXTS + [(20, two * 4), (None, two * 4), (21, two * 4), (20, two * 4)]
    docs = documents(spark, texts, ("text_key", "chunk", "wanted", "content"))
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert [r for r in rows if r.doc_id == 1][0].text is None
    assert sum(r.doc_id == 4 for r in rows) == 2
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert line_dedup.without_repeats(documents(spark, [])).collect() == []


def plain_passages(texts):
    """Every run of lines, without chunks or windows, beside all earlier runs."""
    places = defaultdict(list)
    lines = {i: text.split("\n") for i, text in texts}
    runs = [(i, a, b) for i in lines for a in range(len(lines[i])) for b in range(a + 2, min(a + 9, len(lines[i]) + 1))]
    for i, a, b in sorted(runs):
        content = "\n".join(lines[i][a:b])
        if len(content.encode()) >= line_dedup.LEAST_BYTES:
            places[content].append((i, a, b))
    gone = defaultdict(set)
    for at in places.values():
        first = at[0]
        for i, a, b in at[1:]:
            if i != first[0] or a >= first[2]:
                gone[i] |= set(range(a, b))
    left = {i: "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i]) for i in lines}
    return {i: t for i, t in left.items() if t.strip() or not gone[i]}


def test_short_passages_go_whole(spark):
    line = lambda k: prose(7000 + k, 45)
    passages = ["\n".join(line(10 * k + j) for j in range(2 + k % 3)) for k in range(9)]
    texts = [(n, "\n".join([line(1000 + n), passages[n % 9], line(2000 + n), f"short {n}"])) for n in range(27)]
    texts += [(30, texts[0][1]), (31, "\n".join(["a b", "x" * 30, "y" * 30, "z"])), (32, "\n".join(["x" * 30, "y" * 30, "z", "new"])),
              (33, "\n".join([line(5)] * 5)), (34, "one\ntwo"), (35, "one\ntwo"), (36, line(2003)), (37, "é" * 25 + "\nß\n" + line(9))]
    out = {r.doc_id: r.text for r in line_dedup.without_passages(documents(spark, texts)).collect()}
    assert out == plain_passages(texts)
    assert out[9] == "\n".join([line(1009), line(2009), "short 9"]) and 30 not in out
    assert out[36] == line(2003)  # a single line is no passage
    odd = line_dedup.without_passages(documents(spark, ODD_TEXTS))
    assert odd.count() == len(ODD_TEXTS)


def test_passages_in_odd_rows(spark):
    two = "the same line that is long enough to count as one\nand another line after it that is long too\n"
    texts = ODD_TEXTS + [(20, two * 4), (None, two * 4), (21, two * 4), (20, two * 4), (22, "tie\n" + two)]
    docs = documents(spark, texts, ("text_key", "chunk", "wanted", "content", "first", "gone"))
    out = line_dedup.without_passages(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert [r for r in rows if r.doc_id == 1][0].text is None
    assert sum(r.doc_id == 4 for r in rows) == 2
    # the null doc_id comes first: its first pair of lines is the one that stays
    assert [r.text for r in rows if r.doc_id is None and "same" in r.text] == [two]
    assert not [r for r in rows if r.doc_id in (20, 21)]
    assert [r.text for r in rows if r.doc_id == 22] == ["tie"]
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert line_dedup.without_passages(documents(spark, [])).collect() == []
