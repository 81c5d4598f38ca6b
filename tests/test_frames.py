import tracemalloc

from lodestone.functions import frames


def test_pieces_are_bounded_and_made_as_needed():
    taken = []

    def rows():
        for i in range(10):
            taken.append(i)
            yield {"a": i, "b": b"x" * (100 if i < 5 else 1), "c": None}

    pieces = frames.in_pieces(rows(), ["a", "b", "c"], most=3, most_bytes=150)
    first = next(pieces)
    assert first.a.tolist() == [0, 1] == taken  # by bytes
    sizes = [len(first), *map(len, pieces)]
    assert sizes == [2, 2, 3, 3] and first.c.tolist() == [None, None]
    assert list(frames.in_pieces([], ["a"])) == []


def test_a_worker_holds_a_piece_of_a_batch(spark):
    """A batch of many rows whose results are large: their peak in the worker is that of a piece."""

    def each(i):
        if i == 0:
            tracemalloc.start()
        yield i, "x" * 100_000, tracemalloc.get_traced_memory()[1] if i == 1999 else 0

    found = frames.map_rows(spark.range(0, 2000, 1, 1), each, "id long, text string, peak long", ["id", "text", "peak"])
    assert found.groupBy().max("id", "peak").first()[0] == 1999
    assert 0 < found.agg({"peak": "max"}).first()[0] < 60_000_000  # all results are 200 MB
