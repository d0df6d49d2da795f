"""The operators' registered queries and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import chat, fingerprint, langid, merkle, mixing, packing, quality, rules, simhash_dedup, sstable, substring_dedup, trie, warc

QUERIES = {
    f.__name__: f
    for f in (
        simhash_dedup.op1_simhash_dedup,
        langid.op2_langid,
        quality.op3_quality,
        mixing.op4_mix,
        rules.op5_rules,
        sstable.op6_sstable,
        chat.op7_chat,
        fingerprint.op8_fingerprint,
        substring_dedup.op9_substring_dedup,
        packing.op10_pack,
        warc.op11_warc,
        merkle.op12_merkle,
        trie.op13_trie,
    )
}
ORACLE_SQL = {"op4_mix": mixing.OP4_SQL, "op5_rules": rules.OP5_SQL, "op7_chat": chat.OP7_SQL, "op11_warc": warc.OP11_SQL, "op12_merkle": merkle.OP12_SQL, "op13_trie": trie.OP13_SQL}
