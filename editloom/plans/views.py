"""Views that derive sequences, hits and aligned patterns from the driver's tables, in SQL for Spark and DuckDB alike.

``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text(x: str) -> str:
    return f"cast({x} as varchar(12))"


def bases(*salted: str, letters: str = "ACGTACGTACGTACGT") -> str:
    """32 letters for each expression, from its md5."""
    return f"translate(concat({', '.join(f'md5({s})' for s in salted)}), '0123456789abcdef', '{letters}')"


GAPPED = "ACGTACGTACGTAC--"
DNA = f"select {text('p_partkey')} id, {bases(*(f'concat({chr(39)}d{n}-{chr(39)}, {text("p_partkey")})' for n in (1, 2, 3)))} seq, p_partkey ordinal from {{part}}"


def _f_id(key: str) -> str:
    return f"concat('F', cast({key} % 6 as varchar(4)))"


def _r_id(key: str) -> str:
    return f"concat('R', cast({key} as varchar(4)))"


INDEX_LIST = f"""select concat('P', cast(n_nationkey as varchar(4))) pair_id, {_f_id('n_nationkey')} f_id, substr({bases(_f_id('n_nationkey'))}, 1, 24) f_seq,
 {_r_id('n_regionkey')} r_id, substr({bases(_r_id('n_regionkey'))}, 1, 24) r_seq, n_nationkey ordinal from {{nation}}"""
PRIMERS = f"""select concat('G', cast(n_nationkey as varchar(4)), case when k = 1 then '_F' when k = 2 then '_R' else '_X' end) primer_id,
 substr({bases("concat('p', cast(n_nationkey * 3 + k as varchar(4)))")}, 1, 20) seq from {{nation}} cross join (select 1 k union all select 2 union all select 3) t"""


def raw_hits(side: str) -> str:
    """Hits of index sequences with reads; a line gives one on either side, at the end that its number chooses."""
    front = "l_linenumber <= 5" if side == "F" else "l_linenumber > 5"
    return f"""select concat('{side}', cast(l_suppkey % 6 as varchar(4))) qseqid, l_orderkey sseqid,
 cast(case when l_partkey % 5 < 4 then 1 else 1 + l_partkey % 20 end as int) qstart, case when l_partkey % 7 < 5 then 24 else 22 end qend, 24 qlen,
 case when {front} then 15 + cast(l_quantity as int) else 400 - cast(l_quantity as int) end sstart, 420 slen,
 case when l_tax < 0.05 then 0 else cast(l_suppkey % 3 as int) end mismatch, case when l_discount < 0.08 then 0 else 1 end gapopen from {{lineitem}}"""


BEST = "select * from (select *, row_number() over (partition by qseqid, sseqid order by qend - qstart desc, mismatch, gapopen, qstart, sstart) rn from ({0}) a) b where rn = 1"


def hits(side: str) -> str:
    return f"select qseqid, sseqid, qstart, qend, qlen, sstart, slen, mismatch, gapopen from ({BEST.format(raw_hits(side))}) h"


def long_hits(side: str) -> str:
    """The best hits in the long layout, with rows of the alignment."""
    span = "qend - qstart + 1"
    return f"""select qseqid, sseqid, qstart, qend, qlen, sstart, cast(sstart + qend - qstart as int) send, slen, mismatch, gapopen, substr({bases(text('sseqid'))}, 3, {span}) sseq,
 substr({bases('qseqid')}, qstart, {span}) qseq from ({hits(side)}) h"""


def long_columns(side: str) -> dict[str, str]:
    """What ``long_hits`` adds to a hit, from the columns of a pair's side (f or r)."""
    span = f"qend_{side} - qstart_{side} + 1"
    return {
        f"send_{side}": f"cast(sstart_{side} + qend_{side} - qstart_{side} as int)", f"sseq_{side}": f"substr({bases(text('sseqid'))}, 3, {span})",
        f"qseq_{side}": f"substr({bases(f'qseqid_{side}')}, qstart_{side}, {span})",
    }


_GENE = "concat('G', cast(l_suppkey % 8 as varchar(2)))"
WINDOWS = f"select distinct {_GENE} gene, substr({bases(_GENE)}, 1, 21) seq from {{lineitem}}"
_EDITED = """case when v < t then seq when v < 18 then (case (case when v < 14 then k else (k + 1) % 4 end)
 when 0 then concat(substr(seq, 1, 9), translate(substr(seq, 10, 1), 'ACGT', 'CGTA'), substr(seq, 11))
 when 1 then concat(substr(seq, 1, 10), 'AC', substr(seq, 11)) when 2 then concat(substr(seq, 1, 8), '---', substr(seq, 12))
 else concat(substr(seq, 1, 6), '--', substr(seq, 9, 4), 'GTTCA', substr(seq, 13)) end) else substr(noise, 1, 21) end"""
_READ = f"""select concat('S', cast(l_linenumber as varchar(2))) index_pair_id, {_GENE} target_gene, l_orderkey read_name, cast(l_partkey % 20 as int) v,
 cast((l_linenumber * 3 + l_suppkey % 8) % 12 as int) t, cast((l_suppkey % 8 + l_linenumber) % 4 as int) k"""
_NOISE = bases(text("l_partkey"))
ALIGNED = f"""select index_pair_id, target_gene, read_name, {_EDITED} read_seq from (
 {_READ}, {_NOISE} noise from {{lineitem}}) a
 join ({WINDOWS}) w on a.target_gene = w.gene"""


def windows(t) -> DataFrame:
    """The rows of WINDOWS, with a sequence made once a gene."""
    return t(f"select gene, substr({bases('gene')}, 1, 21) seq from (select distinct {_GENE} gene from {{lineitem}}) g")


def aligned(t) -> DataFrame:
    """The rows of ALIGNED. Genes are few, so reads are not shuffled by gene; noise is made for the reads that have it."""
    reads = t(f"{_READ}, l_partkey from {{lineitem}}")
    return reads.join(F.broadcast(windows(t)), F.col("target_gene") == F.col("gene")).selectExpr("index_pair_id", "target_gene", "read_name", f"{_EDITED.replace('noise', _NOISE)} read_seq")


def _gapped(letter: str) -> str:
    return bases(*(f"concat('{letter}{n}-', {text('o_orderkey')})" for n in (1, 2, 3)), letters=GAPPED)


ALIGNMENTS = f"select {text('o_orderkey')} id, {_gapped('q')} q, {_gapped('s')} s, cast(5 + o_custkey % 70 as int) st from {{orders}}"
#: Two amplicons' worth of hits per read, with windows: genes are the queries.
GENE_HITS = f"""select {_GENE} qseqid, l_orderkey sseqid, cast(1 + l_partkey % 60 as int) qstart, cast(61 + l_partkey % 90 as int) qend, cast(l_suppkey % 8 as int) ordinal,
 cast(l_suppkey % 3 as int) mismatch, 0 gapopen from {{lineitem}}"""
TARGETS = "select gene, seq, 40 \"start\", 60 \"end\" from (" + WINDOWS + ") w"

def _amplicon_hits(key: str, letters: str) -> str:
    q, s = (_gapped(x) for x in letters)
    return f"""select concat('G', cast({key} % 8 as varchar(2))) qseqid, o_orderkey sseqid, cast(1 + {key} % 50 as int) qstart, cast(50 + {key} % 70 as int) qend,
 cast(10 + {key} % 9 as int) sstart, cast(100 + {key} % 11 as int) send, {q} qseq, {s} sseq, cast({key} % 8 as int) ordinal, 0 mismatch, 0 gapopen from {{orders}}"""


#: Hits of amplicons with their alignments; every third read has two.
AMPLICON_HITS = _amplicon_hits("o_custkey", "qs") + " union all " + _amplicon_hits("(o_custkey + 3)", "uv") + " where o_custkey % 3 = 0"
#: Hits of primers in the short layout, on both strands, some of them cut short or with a mismatch.
PRIMER_HITS = f"""select primer_id qseqid, concat('chr', cast(p_partkey % 50 as varchar(4))) sseqid, 1 qstart, cast(20 - p_size % 2 as int) qend, cast(case when p_size < 25 then p_partkey else p_partkey + 19 end as int) sstart,
 cast(case when p_size < 25 then p_partkey + 19 else p_partkey end as int) send, cast(20 - p_size % 2 as int) length, cast(case when p_partkey % 3 = 0 then 95 else 100 end as double) pident
 from {{part}} join ({PRIMERS}) p on primer_id in (concat('G', cast(p_partkey % 25 as varchar(4)), '_F'), concat('G', cast(p_partkey % 25 as varchar(4)), '_R'))"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def duck(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace('"', "`"), **used)
