"""Mates whose records share an offset."""

import itertools

from cytolake.operators import reads as r


def test_records_at_one_offset_go_by_their_values(spark):
    """Of equal offsets the largest ref, pos, mapq, length and flag counts, in whatever order the records come."""
    first = [("a", "chr1", 5, 9, "ACG", 7, 65), ("a", "chr2", 3, 1, "AC", 7, 65), ("a", "chr2", 3, 1, "ACGT", 7, 65), ("a", "chr2", 3, 1, "ACGT", 7, 83), ("a", "chr9", 9, 9, "A", 6, 65)]
    second = ("a", "chr2", 8, 4, "AA", 9, 131)
    for order in itertools.islice(itertools.permutations(first), 0, 120, 17):
        df = spark.createDataFrame([*order, second], "name string, ref string, pos int, mapq int, seq string, file_offset long, flag int").coalesce(1)
        row = r.pair_reads(df).first()
        assert (row.ref_1, row.pos_1, row.mapq_1, row.length_1, row.reverse_1, row.proper, row.distance) == ("chr2", 3, 1, 4, True, True, 5)
