"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from kinfold.llm.chat import op10_event_log
from kinfold.llm.decontaminate import op5_suffix_arrays
from kinfold.llm.langid import op1_zstd_dictionaries
from kinfold.llm.mixing import op9_sainte_lague
from kinfold.llm.neardup import op6_hamming_join
from kinfold.llm.pii import op2_weak_supervision
from kinfold.llm.quality import op7_kneser_ney
from kinfold.llm.sharding import op4_hash_tree
from kinfold.llm.token_counts import op8_count_viterbi
from kinfold.llm.token_files import op3_plane_files

QUERIES = {
    "op1_zstd_dictionaries": op1_zstd_dictionaries,
    "op2_weak_supervision": op2_weak_supervision,
    "op3_plane_files": op3_plane_files,
    "op4_hash_tree": op4_hash_tree,
    "op5_suffix_arrays": op5_suffix_arrays,
    "op6_hamming_join": op6_hamming_join,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_count_viterbi": op8_count_viterbi,
    "op9_sainte_lague": op9_sainte_lague,
    "op10_event_log": op10_event_log,
}

_CONTROL = "<|im_end|><|im_start|>assistant ok"

ORACLES: dict[str, str] = {
    "op5_suffix_arrays": """
with w as (select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') x from documents),
 b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') x from benchmark where item_id is not null),
 bw as (select distinct item_id, least(13, len(x)) n, array_to_string(x[i : i + least(13, len(x)) - 1], ' ') g from (select item_id, x, unnest(range(1, greatest(len(x) - 12, 1) + 1)) i from b where len(x) > 0)),
 dw as (select r, i, n, array_to_string(x[i : i + n - 1], ' ') g from (select r, x, n, unnest(range(1, len(x) - n + 2)) i from w, (select distinct n from bw) where len(x) >= n)),
 bp as (select row_number() over () br, item_id, x from b),
 bi as (select br, item_id, i pos, least(13, len(x)) n, array_to_string(x[i : i + least(13, len(x)) - 1], ' ') g from (select br, item_id, x, unnest(range(1, greatest(len(x) - 12, 1) + 1)) i from bp where len(x) > 0)),
 m as (select dw.r, dw.i, dw.n, bw.item_id from dw join bw using (n, g)),
 d as (select dw.r, dw.i, dw.n, br, item_id, pos, dw.i - row_number() over (partition by dw.r, br, dw.i - pos, dw.n order by dw.i) run from dw join bi using (n, g)),
 l as (select r, item_id, min(i) s, min(pos) ps, count(*) + n - 1 len from d group by r, br, item_id, i - pos, n, run),
 z as (select * from (select *, row_number() over (partition by r order by len desc, s, item_id, ps) k from l) where k = 1),
 h as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from (select distinct r, i, n from m)) group by 1),
 t as (select r, count(*) n_items, string_agg(s, ',' order by s) s from (select distinct r, item_id::varchar s from m) group by 1)
select doc_id, len(x)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(t.s, '')) items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(x) contaminated, len::bigint match_words, (z.s - 1)::bigint match_at, z.item_id::bigint match_item, (ps - 1)::bigint match_item_at
 from w left join h using (r) left join t using (r) left join z using (r)""",
    "op6_hamming_join": """
with recursive w as (select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') x from documents),
 s as (select distinct r, array_to_string(x[i : i + 4], ' ') g from (select r, x, unnest(range(1, greatest(len(x) - 4, 1) + 1)) i from w where len(x) > 0)),
 n as (select r, count(*) n from s group by 1),
 p as (select a.r u, b.r v, count(*) c from s a join s b on a.g = b.g and a.r <> b.r group by 1, 2),
 e as (select u, v from p join n x on x.r = u join n y on y.r = v where 100 * c >= 85 * (x.n + y.n - c)),
 reach(u, v) as (select r, r from w union select reach.u, e.v from reach join e on e.u = reach.v),
 c as (select reach.u r, min(w.doc_id) component_id from reach join w on w.r = reach.v group by 1)
select doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept from w join c using (r) left join n using (r)""",
    "op10_event_log": f"""
with t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations union all select -1, 0, 'user', '{_CONTROL}' union all select -1, 1, 'assistant', '{_CONTROL}')
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
 coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
 sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\\\*\\|')))::bigint formatted_chars from t group by 1""",
}
"""The rest has hashes, tokenizers, compression or models that SQL lacks; tests hold it against brute force."""
