"""The command line, file to file."""

import gzip
from pathlib import Path

import pytest

from skein import __main__ as cli


def out(folder: Path) -> list[str]:
    return sorted(x for p in folder.glob("*.gz") for x in gzip.decompress(p.read_bytes()).decode().splitlines())


@pytest.fixture
def files(tmp_path):
    (tmp_path / "sizes").write_text("a\t40\nb\t40\nc\t40\n")
    (tmp_path / "x.pairs").write_text("## pairs\n#columns: x\n" + "".join(f"r{i}\ta\t{5 + i}\tb\t{31 - i}\t+\t-\t{i}\n" for i in range(4)))
    (tmp_path / "x.porec").write_text("".join(f"{r}\t9\t{k}\t{k + 1}\t+\t{ch}\t{r}\t{r + 4}\t9\t0.9\tpass\n" for r in range(6) for k, ch in enumerate("ab" if r % 2 else "abc")))
    (tmp_path / "x.bed").write_text("a\t0\t7\nb\t0\t40\n")
    (tmp_path / "x.tour").write_text("g1\ta+ b-\ng2\tc+\n")
    (tmp_path / "x.fa").write_text(">a\nAAGATCAA\n>b\nGATCGATC\n")
    (tmp_path / "x.paf").write_text("r1\t90\t0\t50\t+\ta\t40\t0\t30\t28\t30\t60\tNM:i:2\nr1\t90\t50\t90\t+\tb\t40\t0\t30\t28\t30\t60\nr2\t90\t0\t50\t+\ta\t40\t0\t30\t28\t30\t60\n")
    (tmp_path / "x.cluster").write_text("g1\t2\ta b\ng2\t1\tc\n")
    (tmp_path / "x.contacts").write_text("a\tb\t4\na\tc\t1\nb\tc\t2\n")
    (tmp_path / "x.alleles").write_text("1\t2\ta\tb\t9\t9\t9\t1.0\t1\n")
    (tmp_path / "x.agp").write_text("g1\t1\t40\t1\tW\ta\t1\t40\t+\ng1\t41\t140\t2\tU\t100\tscaffold\tyes\tproximity_ligation\ng1\t141\t180\t3\tW\tb\t1\t40\t-\ng2\t1\t40\t1\tW\tc\t1\t40\t+\n")
    (tmp_path / "x.assembly").write_text(">a 1 40\n>b 2 40\n>c 3 40\n1 -2\n3\n")
    (tmp_path / "x.depth").write_text("a\t0\t20\t4\na\t20\t40\t5\nb\t0\t20\t0\n")
    (tmp_path / "x.count").write_text("a\t3\t40\nb\t4\t40\n")
    (tmp_path / "x.clm").write_text("a+ b-\t2\t5 9\na+ c+\t1\t7\n")
    (tmp_path / "x.gfa").write_text("S\ta\tACGT\nS\tb\tAC\nL\ta\t+\tb\t+\t2M\n")
    return tmp_path


CASES = [
    ("pairs2contacts", "x.pairs", [], ["a\tb\t4"]),
    ("pairs-filter", "x.pairs", ["--mapq", "3"], ["r3\ta\t8\tb\t28\t+\t-\t3"]),
    ("pairs-intersect", "x.pairs", ["--bed", "x.bed"], ["r0\ta\t5\tb\t31\t+\t-\t0", "r1\ta\t6\tb\t30\t+\t-\t1"]),
    ("pairs2depth", "x.pairs", ["--contigs", "sizes", "--binsize", "20"], ["a\t0\t20\t4", "a\t20\t40\t0", "b\t0\t20\t0", "b\t20\t40\t4", "c\t0\t20\t0", "c\t20\t40\t0"]),
    ("pairs2pixels", "x.pairs", ["--contigs", "sizes", "--binsize", "40"], ["0\t1\t4"]),
    ("tour2agp", "x.tour", ["--contigs", "sizes"], ["g1\t1\t40\t1\tW\ta\t1\t40\t+", "g1\t141\t180\t3\tW\tb\t1\t40\t-", "g1\t41\t140\t2\tU\t100\tscaffold\tyes\tproximity_ligation", "g2\t1\t40\t1\tW\tc\t1\t40\t+"]),
    ("count-re", "x.fa", ["--motif", "GATC"], ["a\t1\t8", "b\t2\t8"]),
    ("chromsizes", "x.fa", [], ["a\t8", "b\t8"]),
    ("agp2assembly", "x.agp", ["--contigs", "sizes"], ["1 -2", "3", ">a 1 40", ">b 2 40", ">c 3 40"]),
    ("assembly2agp", "x.assembly", [], ["group1\t1\t40\t1\tW\ta\t1\t40\t+", "group1\t141\t180\t3\tW\tb\t1\t40\t-", "group1\t41\t140\t2\tU\t100\tscaffold\tyes\tproximity_ligation", "group2\t1\t40\t1\tW\tc\t1\t40\t+"]),
    ("agp2fasta", "x.agp", ["--fasta", "x.fa", "--gap", "2"], ["AAGATCAANNGATCGATC", ">g1"]),
    ("build", "x.tour", ["--fasta", "x.fa", "--gap", "1"], ["AAGATCAANGATCGATC", ">g1"]),
    ("agp-stats", "x.agp", [], ["g1\t2\t1\t180", "g2\t1\t0\t40"]),
    ("agp-bins", "x.agp", ["--binsize", "100"], ["g1\t0\t100\ta\t+", "g1\t100\t180\tb\t-", "g2\t0\t40\tc\t+"]),
    ("cluster2tour", "x.cluster", [], ["g1\ta+ b+", "g2\tc+"]),
    ("cluster2assembly", "x.cluster", ["--contigs", "sizes"], ["1 2", "3", ">a 1 40", ">b 2 40", ">c 3 40"]),
    ("cluster2count", "x.cluster", ["--counts", "x.count"], ["g1\ta\t3\t40", "g1\tb\t4\t40"]),
    ("cluster2fasta", "x.cluster", ["--fasta", "x.fa"], ["AAGATCAA", ">a g1", ">b g1", "GATCGATC"]),
    ("fasta2cluster", "x.fa", [], ["a\t1\ta", "b\t1\tb"]),
    ("evaluator", "x.agp", ["--truth", "x.agp"], ['{"tp":1,"fp":0,"fn":0,"precision":1.0,"recall":1.0,"f1":1.0,"contigs":3,"grouping_errors":0,"grouping_rate":0.0,"orientation_errors":0,"misplaced":0,"unanchored":0,"edit_distance":0,"edit_rate":0.0}']),
    ("scaffolding", "x.pairs", ["--contigs", "sizes", "--clusters", "x.cluster"], None),
    ("partition", "x.porec", ["--contigs", "sizes", "--weight", "0", "--groups", "1"], None),
    ("partition2", "x.porec", ["--contigs", "sizes", "--weight", "0", "--groups", "1", "--per", "1"], None),
    ("rescue", "x.porec", ["--contigs", "sizes", "--weight", "0", "--clusters", "x.cluster"], None),
    ("recluster", "x.porec", ["--contigs", "sizes", "--weight", "0", "--clusters", "x.cluster"], None),
    ("chimeric", "x.pairs", ["--contigs", "sizes", "--binsize", "5"], None),
    ("split-contacts", "x.contacts", ["--clusters", "x.cluster"], ["g1\ta\tb\t4"]),
    ("split-clm", "x.clm", ["--clusters", "x.cluster"], ["g1\ta+ b-\t2\t5 9"]),
    ("kprune", "x.contacts", ["--alleles", "x.alleles"], ["a\tb\t0"]),
    ("hcr", "x.depth", ["--low", "4"], ["a\t0\t40"]),
    ("copies", "x.depth", ["--peak", "5"], ["a\t4.5\t0.0\t0.9", "b\t0.0\t0.0\t0.0"]),
    ("copy-classes", "x.depth", ["--peak", "5"], ["error\t1\t20\t0.333333", "haploid\t2\t40\t0.666667"]),
    ("porec-stats", "x.porec", [], ['{"reads":6,"mean_order":2.5,"median_order":2.5,"bases":60,"pairwise":12}']),
    ("porec2incidence", "x.porec", [], None),
    ("porec2rows", "x.porec", [], None),
    ("porec-downsample", "x.porec", ["--number", "4"], None),
    ("hypergraph", "x.porec", [], None),
    ("hypergraph2contacts", "x.porec", ["--weight", "0"], None),
    ("pairs2split-contacts", "x.pairs", ["--contigs", "sizes"], None),
    ("extract", "x.pairs", ["--contigs", "sizes", "--mapq", "3"], ["r3\ta\t8\tb\t28\t+\t-\t3"]),
    ("remove", "x.pairs", ["--contigs", "sizes"], []),
    ("pairs-chrom2contig", "y.pairs", ["--agp", "x.agp"], ["q\ta\t5\tb\t2"]),
    ("paf2pairs", "x.paf", [], None),
    ("paf2depth", "x.paf", ["--contigs", "sizes", "--binsize", "40"], ["a\t0\t40\t4", "b\t0\t40\t2", "c\t0\t40\t0"]),
    ("overlaps", "x.paf", ["--edge", "9"], None),
    ("sequence-windows", "x.fa", ["--binsize", "4"], ["AAGA", "TCAA", ">a_0", ">a_4", ">b_0", ">b_4", "GATC", "GATC"]),
    ("site-bins", "x.fa", ["--motif", "GATC", "--binsize", "4"], None),
    ("telomeres", "x.fa", ["--motif", "GATC"], None),
    ("gfa-links", "x.gfa", [], None),
    ("gfa-topology", "x.gfa", [], None),
    ("rename", "x.paf", ["--clusters", "x.cluster"], None),
    ("paf-stats", "x.paf", [], ['{"total":3,"n_pass":2,"n_low_mq":0,"n_singleton":1,"reads":2,"reads_pass":1}']),
]


@pytest.mark.parametrize(("verb", "source", "options", "want"), CASES)
def test_verbs(spark, files, verb, source, options, want):
    (files / "y.pairs").write_text("q\tg1\t5\tg1\t142\t+\t+\t9\n")
    options = [str(files / o) if o == "sizes" or o.startswith("x.") else o for o in options]
    assert cli.main([verb, str(files / source), "-o", str(files / "out"), *options]) == 0
    got = out(files / "out")
    assert got == sorted(want) if want is not None else isinstance(got, list)


def test_store_pairs_and_chains_of_verbs(spark, files):
    cli.main(["pairs2store", str(files / "x.pairs"), "-o", str(files / "store")])
    cli.main(["pairs-filter", str(files / "store"), "-o", str(files / "o1"), "--mapq", "2"])
    assert len(out(files / "o1")) == 2
    cli.main(["porec2pairs", str(files / "x.porec"), "-o", str(files / "o2")])
    assert len(out(files / "o2")) == 3 * 1 + 3 * 3
    cli.main(["hyperpartition", str(files / "x.porec"), "-o", str(files / "o3"), "--contigs", str(files / "sizes"), "--weight", "0"])
    assert sorted(n for line in out(files / "o3") for n in line.split("\t")[2].split()) == ["a", "b", "c"]
    cli.main(["tour2agp", str(files / "x.tour"), "-o", str(files / "agp"), "--contigs", str(files / "sizes"), "--compression", "none"])
    cli.main(["agp2tour", str(files / "agp"), "-o", str(files / "o4")])
    assert out(files / "o4") == ["g1\ta+ b-", "g2\tc+"]
