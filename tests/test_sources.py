"""File readers on files: split, cut, compressed, with the line ends and marks that real files have."""

import gzip
import random

import pytest

from cytolake.sources import readers as s


def records(seed, n):
    """Reads of random lengths; many quality lines begin with @, some hold nothing else, some reads are empty."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 2, rng.randint(3, 90)])
        qual = "".join(rng.choice("@+!IJ@") for _ in range(size))
        out.append((f"r{i}", rng.choice(["", "1:N:0:ACGT"]), "".join(rng.choice("ACGTN") for _ in range(size)), "@" + qual[1:] if qual and rng.random() < 0.5 else qual))
    return out


def text_of(rows, end="\n"):
    return "".join(f"@{a}{' ' * bool(b)}{b}{end}{c}{end}+{end}{q}{end}" for a, b, c, q in rows)


@pytest.fixture
def small_splits(spark):
    """Splits of about the size of a record or two, so that every kind of place becomes a boundary."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


def read(spark, path):
    return sorted(tuple(r) for r in s.read_fastq(spark, str(path)).collect())


@pytest.mark.parametrize("size", [61, 64, 97, 150, 1000])
def test_one_fastq_file_splits_anywhere(spark, tmp_path, small_splits, size):
    rows = records(size, 150)
    (tmp_path / "a.fastq").write_text(text_of(rows))
    small_splits(size)
    assert spark.read.option("lineSep", "\n@").text(str(tmp_path / "a.fastq")).rdd.getNumPartitions() > 5
    assert read(spark, tmp_path / "a.fastq") == sorted(rows)


def test_fastq_line_ends_blank_lines_cut_records_and_gzip(spark, tmp_path):
    rows = records(7, 60)
    (tmp_path / "a.fastq").write_bytes((text_of(rows, "\r\n") + "\r\n\r\n").encode())
    assert read(spark, tmp_path / "a.fastq") == sorted(rows)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(text_of(rows).encode()))
    assert read(spark, tmp_path / "b.fastq.gz") == sorted(rows)
    (tmp_path / "c.fastq").write_text(text_of(rows).removesuffix("\n") + "\n@cut\nACGT\n+")
    assert read(spark, tmp_path / "c.fastq") == sorted(rows)
    (tmp_path / "d.fastq").write_text("")
    assert read(spark, tmp_path / "d.fastq") == []
    assert read(spark, tmp_path / "*.fastq*") == sorted(rows * 3)


def test_fastq_pairs_by_id(spark, tmp_path):
    rows = records(8, 40)
    (tmp_path / "a.fastq").write_text(text_of(rows))
    (tmp_path / "b.fastq").write_text(text_of(rows[::-2]))
    got = s.read_fastq_pairs(spark, str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq")).collect()
    want = {a: (c, q) for a, _, c, q in rows[::-2]}
    assert {r.read_id: (r.seq_2, r.qual_2) for r in got} == want and all(r.seq_1 == r.seq_2 for r in got)


def test_sam_tags_of_any_number_and_length(spark, tmp_path):
    long, many = "x" * 150_000, [f"{a}{b}:Z:{k}" for k, (a, b) in enumerate((a, b) for a in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKL" for b in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKL")]
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n" + "\t".join(["r1", "0", "chr1", "7", "60", "5M", "*", "0", "0", "ACGTA", "*", *many, f"ZZ:Z:{long}"]) + "\n")
    row = s.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert len(row.tags) == len(many) + 1 and row.tags["ZZ"] == long and row.tags["LL"] == str(len(many) - 1)
