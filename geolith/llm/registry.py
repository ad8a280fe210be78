"""Queries of the training-data operators over the shared tables, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm.op1_mpeg_audio import store_media
from geolith.llm.op2_run_length_dedup import dedup_bytes
from geolith.llm.op3_toxicity import learn_index, score_toxicity
from geolith.llm.op4_jaccard_join import near_duplicates
from geolith.llm.op5_packing import pack
from geolith.llm.op6_language_id import identify, learn_model
from geolith.llm.op7_byte_bpe import encode_bpe
from geolith.llm.op8_token_counts import count_tokens
from geolith.llm.op9_url_filters import filter_urls
from geolith.llm.op10_quality_rules import quality
from geolith.llm.op11_ranked_search import ranked_search
from geolith.llm.op12_stream_dedup import dedup_files
from geolith.llm.op13_period_runs import period_runs


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(folds: int):
    """crc32 of the decimal doc_id modulo ``folds``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_media(documents(spark, sf_dir))


def op2_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    return score_toxicity(docs, learn_index(docs, labels, fold(5) != 0), extra=(held_out.alias("held_out"),))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), F.coalesce(fold(4) == 2, F.lit(False))
    return identify(docs, learn_model(docs, ~held_out), extra=(held_out.alias("held_out"),))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_bpe(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_files(spark, f"{sf_dir}/documents.parquet")


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order in which a tenth of the documents are read: from some word on, the words of a period again and again."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    first = g % n
    places = np.arange(n)
    places[first:] = first + (places[first:] - first) % (1 + (n - first) // (3 + g % 8))
    return places


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs(documents(spark, sf_dir), order=looped)


QUERIES = {
    "op1_mpeg_audio": op1_mpeg_audio,
    "op2_run_length_dedup": op2_run_length_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_url_filters": op9_url_filters,
    "op10_quality_rules": op10_quality_rules,
    "op11_ranked_search": op11_ranked_search,
    "op12_stream_dedup": op12_stream_dedup,
    "op13_period_runs": op13_period_runs,
}
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_run_length_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, cast(strlen(coalesce(text, '')) as bigint) as n from documents),
        w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, n - 49)) as i from d where n >= 50)),
        f as (select s, min(doc_id) as m from w group by 1),
        r as (select w.doc_id, i from w join f using (s) where m < w.doc_id),
        g as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as new from r),
        k as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from g),
        s as (select doc_id, run, min(i) as a, max(i) + 50 as b from k group by 1, 2),
        q as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from s),
        p as (select q.*, substr(h, 2 * before + 1, 2 * (a - before)) as piece from q join d using (doc_id)),
        c as (select doc_id, string_agg(piece, '' order by a) as kept, cast(sum(b - a) as bigint) as removed, count(*) as spans, max(b) as last from p group by 1)
        select d.doc_id, n as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans,
          sha256(unhex(case when c.doc_id is null then h else kept || substr(h, 2 * last + 1) end)) as kept_sha256 from d left join c using (doc_id)""",
    "op4_jaccard_join": f"""
        with recursive w as (select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
        s as (select distinct doc_id, shingle from (select doc_id, w[i : i + 4] as shingle from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5) union all select doc_id, w from w where len(w) between 1 and 4)),
        n as (select doc_id, count(*) as n from s group by 1),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (shingle) where a.doc_id < b.doc_id group by 1, 2),
        l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
        e as (select x, y from l union select y, x from l),
        r as (select doc_id as node, doc_id as root from documents union select e.y, r.root from r join e on e.x = r.node)
        select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.root) as component_id from documents d left join n using (doc_id) join r on r.node = d.doc_id group by 1""",
    "op10_quality_rules": f"""
        with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as source from documents),
        w as (select *, {WORDS.format("text")} as w from d),
        t as (select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
        f as (select doc_id, i from t qualify count(*) over (partition by doc_id, a, b, c) > 1),
        q as (select doc_id, count(distinct i + k) as n_repeat_words from f, (select unnest([0, 1, 2]) as k) group by 1),
        l as (select doc_id, source, line, {WORDS.format("line")} as lw from (select doc_id, source, unnest(string_split(text, chr(10))) as line from d)),
        m as (select doc_id, source, line, len(lw) as own, lower(array_to_string(lw, ' ')) as norm from l where len(lw) > 0),
        u as (select doc_id, count(*) - count(distinct line) as n_dup_lines from m group by 1),
        x as (select source, norm, count(distinct doc_id) as n, min(doc_id) as first from m group by 1, 2),
        y as (select * from x where n > 20),
        z as (select m.doc_id, sum(own) as removed from m join y using (source, norm) where m.doc_id <> y.first group by 1),
        b as (select w.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
          coalesce(n_repeat_words, 0) as n_repeat_words, cast(coalesce(removed, 0) as bigint) as removed_words from w left join q using (doc_id) left join u using (doc_id) left join z using (doc_id))
        select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and removed_words <= 0.5 * n_words as kept from b""",
    "op11_ranked_search": """
        with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from documents),
        c as (select doc_id, term, count(*) as tf from t group by 1, 2),
        d as (select doc_id, cast(sum(tf) as bigint) as n from c group by 1),
        s as (select count(*) as docs, cast(sum(n) as bigint) as words from d),
        w as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from c, s group by 1),
        q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark),
        x as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // words))))) as bigint) as score from q join w using (term) join c using (term) join d using (doc_id), s group by 1, 2),
        r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from x where score > 0)
        select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 50""",
    "op12_stream_dedup": """
        with d as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as norm from documents),
        g as (select doc_id, norm, first_value(doc_id) over (partition by norm order by length(text) desc, doc_id rows between unbounded preceding and unbounded following) as keep_id, count(*) over (partition by norm) as group_size from d)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g""",
}
