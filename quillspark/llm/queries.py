"""The corpus operators' registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontaminate import op5
from .divergence import op12
from .html_text import op1
from .language import op13
from .line_dedup import op2
from .mixing import op7
from .prefix_trie import op11
from .quality import op9
from .simhash import op6
from .substrings import op8
from .toxicity import op3
from .vectors import op10
from .warc import op4

QUERIES = {
    "op1_html_text": op1,
    "op2_line_dedup": op2,
    "op3_toxicity": op3,
    "op4_arc_to_warc": op4,
    "op5_decontaminate": op5,
    "op6_simhash": op6,
    "op7_mix": op7,
    "op8_substring_dedup": op8,
    "op9_quality": op9,
    "op10_vector_dedup": op10,
    "op11_prefix_trie": op11,
    "op12_divergence": op12,
    "op13_language": op13,
}

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({}, ''), lambda c: ord(c)::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_ALNUM = "list_filter(regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op2_line_dedup": f"""
        with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents),
        keyed as (select *, {_KEY} as key from lines),
        held as (select key, count(distinct doc_id) as n, max(doc_id) as last from keyed where length(key) >= 20 group by key),
        marked as (select l.*, h.n >= 3 and l.doc_id <> h.last as gone from keyed l left join held h using (key))
        select doc_id, count(*) as n_lines, count(*) filter (where coalesce(gone, false)) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by k) filter (where not coalesce(gone, false)), '')) as kept_sha256
        from marked group by doc_id""",
    "op4_arc_to_warc": """
        with p as (select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as n from pages),
        last as (select body, max(page_id) as row from p where n >= 1000 group by body)
        select page_id, n as payload_bytes, sha1(p.body) as payload_digest,
               case when row is null or row = page_id then 'response' else 'revisit' end as record_type,
               case when row <> page_id then row end as refers_to
        from p left join last on p.body = last.body and n >= 1000""",
    "op5_decontaminate": f"""
        with items as (select item_id, {_ALNUM.format('text')} as w from benchmark where item_id is not null),
        windows as (select item_id, least(10, len(w)) as m, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda i: array_to_string(w[i:i + 9], ' '))) as win from items where len(w) > 0),
        docs as (select doc_id, {_ALNUM.format('text')} as w from documents),
        sizes as (select distinct m from windows),
        places as (select doc_id, m, unnest(range(1, len(w) - m + 2)) as i, w from docs, sizes where len(w) >= m),
        hits as (select distinct doc_id, i, p.m, item_id from places p join windows v on v.m = p.m and v.win = array_to_string(w[i:i + p.m - 1], ' ')),
        words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + m)) as k from hits) group by doc_id),
        found as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from hits) group by doc_id)
        select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from docs d left join words using (doc_id) left join found using (doc_id)""",
    "op8_substring_dedup": f"""
        with docs as (select doc_id, {_WORDS.format('text')} as w from documents),
        places as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from docs where len(w) >= 13)),
        first as (select win, min(doc_id) as low from places group by win having min(doc_id) <> max(doc_id)),
        gone as (select doc_id, list(distinct k) as ks from (select doc_id, unnest(range(i, i + 13)) as k from places join first using (win) where low < doc_id) group by doc_id),
        words as (select d.doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from docs d),
        cut as (select doc_id, k from (select doc_id, unnest(ks) as k from gone)),
        kept as (select w.doc_id, string_agg(word, ' ' order by w.k) as text from words w left join cut c on c.doc_id = w.doc_id and c.k = w.k where c.k is null group by w.doc_id)
        select d.doc_id, len(w) as n_words, coalesce(len(ks), 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
        from docs d left join gone using (doc_id) left join kept using (doc_id)""",
    "op10_vector_dedup": """
        with recursive v as (select vec_id, embedding::double[] as e, label from embeddings
            where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
        reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
        root as (select a as vec_id, min(b) as component_id from reach group by a),
        n as (select a as vec_id, count(*) as n_links from links group by a)
        select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from embeddings left join root using (vec_id) left join n using (vec_id)""",
    "op11_prefix_trie": f"""
        with raw as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
        t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(role) || ':' || role || text)) as i from raw),
        info as (select conv_id, count(*) as n, conv_id - conv_id % 5 as base, {_CRC32.format('conv_id::varchar')} % 9 as h from t group by conv_id),
        seq as (select c.conv_id, i as d, role, text from info c join t on t.conv_id = c.base where i <= h
            union all select c.conv_id, i - c.h + least(c.h, coalesce(b.n, 0)), role, text from info c join t on t.conv_id = c.conv_id left join info b on b.conv_id = c.base where i > c.h),
        lists as (select conv_id, coalesce(list({{'role': role, 'text': text}} order by d) filter (d is not null), []) as turns from info left join seq using (conv_id) group by conv_id),
        cut as (select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from lists),
        keys as (select conv_id, depth, depth = len(turns) as ends, case when depth > 0 then strlen(turns[depth].text) else 0 end as size,
            array_to_string(list_transform(turns[1:depth], lambda x: strlen(x.role) || ':' || strlen(x.text) || ':' || x.role || x.text), '') as key from cut),
        nodes as (select key, depth, min(conv_id) as conv_id, count(*) as n_convs, min(size) as size, string_agg(conv_id::varchar, ',' order by conv_id) filter (ends) as ids from keys group by key, depth),
        up as (select n.conv_id, n.depth, p.key, p.depth as top_depth from nodes n join keys p on p.conv_id = n.conv_id and p.depth <= n.depth),
        kids as (select key, top_depth as depth, count(*) as n_children from up where top_depth = depth - 1 group by all),
        above as (select u.conv_id, u.depth, p.conv_id as parent_conv_id from up u join nodes p on p.key = u.key and p.depth = u.top_depth where u.top_depth = u.depth - 1),
        every as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids using (key, depth)),
        below as (select u.key, u.top_depth as depth, count(*) filter (e.n_children = 0) as n_leaves, sum((e.n_convs - 1) * e.size)::bigint as saved_tokens from up u join every e on e.conv_id = u.conv_id and e.depth = u.depth group by all)
        select e.conv_id, e.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
        from every e join below using (key, depth) left join above a on a.conv_id = e.conv_id and a.depth = e.depth""",
    "op12_divergence": """
        with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
        t as (select r, lang, source, unnest(w) as term from d),
        kept as (select lang, term from t group by lang, term having count(distinct r) >= 3),
        v as (select lang, count(*) as v from kept group by lang),
        c as (select lang, source, term, count(*) as c from t semi join kept using (lang, term) group by all),
        n as (select g.lang, g.source, coalesce(sum(c), 0)::bigint as n from (select distinct lang, source from d) g left join c using (lang, source) group by all),
        p as (select n.lang, n.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 1)) // (n.n + v.v) as p
            from n join v using (lang) join kept k using (lang) left join c on c.lang = n.lang and c.source = n.source and c.term = k.term),
        whole as (select lang, sum(n)::bigint as n from n group by lang),
        q as (select lang, term, 1 + (1000000000::hugeint * (sum(c)::bigint + 1)) // (any_value(w.n) + any_value(v)) as q from c join whole w using (lang) join v using (lang) group by lang, term),
        far as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
        pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from n a join n b on a.lang = b.lang and a.source <> b.source left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source),
        term as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from p join q using (lang, term) where c > 0 and p > q),
        every as (select * from pair union all select * from term)
        select lang, source, part, item, value, rank::int as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every) where part = 'pair' or rank <= 200""",
}
