import gzip
import struct

import pytest
from pyspark.sql import functions as F

from kinstrand import cli
from kinstrand.sources import bam, text


def put(path, content):
    path.write_text(content)
    return str(path)


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "g.fa", ">one some text\nacgtN\nAC\n>two\nTTTT\n")
    g = text.read_fasta(spark, p)
    assert {tuple(r) for r in g.collect()} == {("one", "ACGTNAC"), ("two", "TTTT")}
    text.write_fasta(g.withColumn("seq", F.repeat("seq", 30)), f"{tmp_path}/out.fa")
    assert {r["chr"]: r["seq"] for r in text.read_fasta(spark, f"{tmp_path}/out.fa").collect()} == {"one": "ACGTNAC" * 30, "two": "TTTT" * 30}
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/out.fa").collect()]
    assert max(map(len, lines)) == 50
    fai = put(tmp_path / "g.fai", "one\t7\t0\t50\t51\ntwo\t4\t0\t50\t51\n")
    assert [tuple(r) for r in text.read_fai(spark, fai).collect()] == [("one", 7, 0), ("two", 4, 1)]


def test_table_round_trip(spark, tmp_path):
    header = "\t".join(text.TABLE_HEADER)
    rows = ["c1\t1\t9\tc2\t11\t19\t2\t-\t3;5\tA;C\tT;G\t17;15\tA;C\tT;G", "c1\t4\t8\tNA\tNA\tNA\t0\t+\tNA\tN\tN\tNA\tN\tN"]
    p = put(tmp_path / "t.tsv", "##note\n" + header + "\n" + "\n".join(rows) + "\nc1\t5\n")
    df = text.read_table(spark, p)
    got = df.where("is_whole").orderBy("align_start").collect()
    assert got[0]["anchors"][1]["origin_pos"] == 15 and got[0]["strand"] == "-" and got[1]["origin_chr"] is None and got[1]["anchors"] == []
    assert df.where("NOT is_whole").count() == 1
    text.write_table(df.where("is_whole").drop("is_whole"), f"{tmp_path}/out", ["note"])
    back = [r["value"] for r in spark.read.text(f"{tmp_path}/out", recursiveFileLookup=True).collect()]
    assert set(back) == {"##note", header, *rows}
    assert text.read_table(spark, f"{tmp_path}/out").count() == 2
    text.write_by_chromosome(df.drop("is_whole"), f"{tmp_path}/parts")
    with pytest.raises(ValueError):
        text.read_table(spark, put(tmp_path / "bad.tsv", "a\tb\n"))


def test_variants_links_regions(spark, tmp_path):
    p = put(tmp_path / "v.vcf", "##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\nc1\t5\t.\tA\tC,T\t9\t.\tX=1\tGT\t0/1\n")
    rows, header = text.read_vcf(spark, p)
    assert len(header) == 2 and rows.first()["alt_base"] == "C,T"
    text.write_vcf(rows, f"{tmp_path}/out.vcf", header, text.FILTER_LINES)
    again, header = text.read_vcf(spark, f"{tmp_path}/out.vcf")
    assert len(header) == 6 and again.first()["genotype"] == "0/1" and again.count() == 1
    p = put(tmp_path / "v.vtf", "##x\nc1:5\tc2:7\tc2:9:rs4\nc1:6\n")
    assert sorted(tuple(r) for r in text.read_links(spark, p).collect()) == [("c1", 5, 0, "c2", 7), ("c1", 5, 1, "c2", 9)]
    text.write_links(text.read_links(spark, p), f"{tmp_path}/out.vtf", ["x"])
    assert text.read_links(spark, f"{tmp_path}/out.vtf").count() == 2
    p = put(tmp_path / "b.bed", "track x\nc1\t0\t5\tname\nc2\t7\t9\n")
    text.write_bed(text.read_bed(spark, p), f"{tmp_path}/out.bed")
    assert {tuple(r) for r in text.read_bed(spark, f"{tmp_path}/out.bed").collect()} == {("c1", 0, 5), ("c2", 7, 9)}


SAM = "@HD\tVN:1.6\nr1\t16\tc1\t5\t60\t4M1I3M\t=\t90\t0\tACGTACGT\t*\nr2\t1028\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n"


def bam_bytes():
    def record(name, flag, ref, pos, mapq, ops, mate, mate_pos, seq):
        code = {c: k for k, c in enumerate("=ACMGRSVTWYHKDBN")}
        packed = bytes((code[seq[k]] << 4) | (code[seq[k + 1]] if k + 1 < len(seq) else 0) for k in range(0, len(seq), 2))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), mate, mate_pos, 0)
        body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + packed + b"\xff" * len(seq)
        return struct.pack("<i", len(body)) + body

    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 1000)
    return gzip.compress(head + record("r1", 16, 0, 4, 60, [(4, "M"), (1, "I"), (3, "M")], 0, 89, "ACGTACGT")) + gzip.compress(record("r2", 1028, -1, -1, 0, [], -1, -1, "AC"))


def test_alignments(spark, tmp_path):
    sam = text.read_sam(spark, put(tmp_path / "a.sam", SAM))
    (tmp_path / "a.bam").write_bytes(bam_bytes())
    keep = "qname chr start_pos end_pos seq mapq unmapped duplicate secondary reverse cigar mate_chr mate_start".split()
    rows = sorted(map(str, sam.select(*keep).collect()))
    assert rows == sorted(map(str, bam.read_bam(spark, f"{tmp_path}/a.bam").select(*keep).collect()))
    r1 = sam.where("qname = 'r1'").first()
    assert (r1["start_pos"], r1["end_pos"], r1["reverse"], r1["mate_chr"]) == (5, 11, True, "c1") and sam.where("unmapped AND duplicate").count() == 1


def test_psl(spark, tmp_path):
    line = "15\t0\t0\t0\t1\t1\t0\t0\t+\tr/1\t20\t2\t18\tc1\t500\t100\t115\t2\t5,10,\t2,8,\t100,105,\n"
    got = text.read_psl(spark, put(tmp_path / "x.psl", line + "short\n")).collect()
    assert len(got) == 1 and got[0]["q_name"] == "r" and got[0]["cigar"] == "2S5M1I10M2S"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from kinstrand.plans.fixtures import relation
    from kinstrand.streaming.arriving import arriving_links, write_arriving

    v, e = relation(spark, sf_dir, "variants"), relation(spark, sf_dir, "entries")
    v.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    write_arriving(stream, e, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, arriving_links(v, e).collect())) and got


def test_commands(spark, tmp_path, capsys):
    import random

    rng = random.Random(3)
    copy = "".join(rng.choice("ATCG") for _ in range(120))
    base = lambda n: "".join(rng.choice("ATCG") for _ in range(n))
    put(tmp_path / "g.fa", f">c1\n{base(60)}{copy}{base(60)}\n>c2\n{base(40)}{copy}{base(50)}\n")
    g, t = f"--genome={tmp_path}/g.fa", str(tmp_path)
    run = lambda *a: cli.main(list(a))
    run("generate", g, f"--output={t}/reads", "--read-length=40", "--divisor=5")
    run("align", g, f"--input={t}/reads", f"--output={t}/hits.sam", "--read-length=40", "--ear-length=6")
    lines = [r[0].split("\t") for r in spark.read.text(f"{t}/hits.sam").collect() if not r[0].startswith("@")]
    assert sum(x[1] == "0" for x in lines) == len({x[0] for x in lines}) and any(x[1] == "256" for x in lines)
    # a read that the aligner gave up, one with an insertion and one of low quality
    put(tmp_path / "more.sam", "T40;c1:101-140\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\nT40;c2:1-40\t256\tc1\t3\t40\t20M1I19M\t*\t0\t0\t*\t*\n")
    run("write", g, f"--bam={t}/hits.sam", f"--bam={t}/more.sam", f"--output={t}/table", "--read-length=40")
    assert [tuple(r) for r in text.read_bed(spark, f"{t}/table.unmapped.bed").collect()] == [("c1", 100, 140)]
    table = text.read_table(spark, f"{t}/table")
    unknown = table.where("origin_chr IS NULL").collect()
    assert [(r["align_chr"], r["align_start"], r["align_end"]) for r in unknown] == [("c1", 101, 140)] and table.where("align_start = 3 AND origin_start = 1").count() == 0
    assert table.where("align_end - align_start >= 100").count() >= 2
    for what in ("align", "origin", "coverage"):
        run("summarize", f"--table={t}/table", f"--output={t}/{what}", f"--what={what}")
    assert text.read_bed(spark, f"{t}/align").count() >= 2
    run("subset", f"--table={t}/table", "--region=c1:0-100", f"--output={t}/sub")
    run("merge2chrom", f"{t}/parts", f"{t}/table", f"{t}/sub")
    put(tmp_path / "g.fa.fai", "c2\t210\nc1\t240\n")
    run("reorder", f"--table={t}/table", g, f"--output={t}/re")
    run("check", f"--table={t}/table")
    run("check", f"--table={t}/table", "--check=trivial")
    numbered = cli._numbered(spark.range(0, 1000, 1, 7).toDF("x")).collect()
    assert sorted(r["row_id"] for r in numbered) == list(range(1000)) and all(r["row_id"] == r["x"] for r in numbered)
    pos = 100
    put(tmp_path / "v.vcf", f"##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\nc1\t{pos}\t.\tA\tC\t9\t.\tX\tGT\t0/1\nc1\t3\t.\tA\tC\t9\t.\tX\tGT\t0/1\n")
    run("filter", g, f"--vcf={t}/v.vcf", f"--table={t}/table", f"--output={t}/f", "--read-length=40")
    rows = {r["pos"]: r for r in text.read_vcf(spark, f"{t}/f.vcf")[0].collect()}
    assert rows[pos]["filt"] == "thesaurus" and rows[pos]["genotype"] == "0/1:1" and rows[3]["filt"] == "PASS"
    assert [(r["to_chr"], r["to_pos"]) for r in text.read_links(spark, f"{t}/f.vtf").collect()] == [("c2", pos - 20)]
    put(tmp_path / "ids.txt", f"c1\t{pos}\trs1\nc2\t{pos - 20}\trs2\n")
    run("annotatevtf", f"--vtf={t}/f.vtf", f"--output={t}/named", f"--database={t}/ids.txt")
    assert spark.read.text(f"{t}/named").first()[0] == f"c1:{pos}:rs1\tc2:{pos - 20}:rs2"
    run("network", f"--vcf={t}/f.vcf", f"--output={t}/net")
    put(tmp_path / "truth.vcf", f"##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc2\t{pos - 20}\t.\tA\tC\t.\t.\t.\n")
    run("compare", f"--ref={t}/truth.vcf", f"--vcf={t}/f.vcf", f"--vtf={t}/f.vtf", f"--output={t}/cmp")
    assert "TPlinked\t1" in capsys.readouterr().out
    put(tmp_path / "b.bed", "c1\t0\t200\nc2\t10\t90\n")
    run("randomVTF", f"--bed={t}/b.bed", f"--vcf={t}/f.vcf", f"--output={t}/rnd", "--seed=4")
    assert text.read_links(spark, f"{t}/rnd").count() == 1
    put(tmp_path / "reads.sam", f"r\t0\tc1\t{pos - 5}\t60\t10M\t*\t0\t0\tACGTACGTAC\t*\n")
    run("details", f"--bam={t}/reads.sam", f"--vcf={t}/v.vcf", f"--output={t}/det")
    run("countpatterns", f"--input={t}/v.vcf", f"--output={t}/pat", "--pattern=c1", "--pattern=9", "--column=1", "--column=6")
    run("newgenome", g, f"--output={t}/new", "--density=0.05", "--seed=2")
    assert text.read_vcf(spark, f"{t}/new.vcf")[0].count() > 3
    run("filter", g, f"--vcf={t}/v.vcf", f"--table={t}/table", f"--output={t}/f2", "--read-length=40", f"--bam={t}/reads.sam", f"--compare-bam={t}/reads.sam", "--compare-label=other")
    assert "sample.thesaurus.BAF" in "\n".join(r[0] for r in spark.read.text(f"{t}/f2.baf", recursiveFileLookup=True).collect())
    run("version")
