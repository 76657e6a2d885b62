from ledgerloom.llm import jaccard_join as jj


def near(word, n=60):
    """Three different texts that are near copies of each other."""
    words = [f"{word}{i}" for i in range(n)]
    return [" ".join([*words, *(f"end{k}" for _ in range(k))]) for k in range(3)]


def test_near_copies_with_equal_or_no_ids(docs):
    a, b, c, d = (near(w) for w in "abcd")
    pairs = [(5, t) for t in a] + [(None, t) for t in b] + [(7, c[0]), (7, c[1]), (None, c[2]), (8, c[2])]
    pairs += [(None, t) for t in d] + [(5, "quite another text with the id of a group"), (None, " "), (None, None)]
    pairs += [(9, d[1]), (None, b[0])]
    for _ in range(2):
        kept = [(r["doc_id"], r["text"]) for r in jj.one_of_each_group(docs(pairs, extra=True)).collect()]
        assert len(kept) == len(set(kept)) == 7
        of = lambda texts: [(i, t) for i, t in kept if t in texts]
        assert [[i for i, _ in of(x)] for x in (a, b, c, d)] == [[5], [None], [7], [9]]
        assert {p for p in kept if p[1] not in a + b + c + d} == {
            (5, "quite another text with the id of a group"), (None, " "), (None, None)
        }
        pairs.reverse()
