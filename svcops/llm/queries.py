"""The registered queries of this folder and their SQL where there is one."""

from __future__ import annotations

from svcops.llm import (alignment, conversations, decontaminate, exact_dedup, html_text, language_id, license_scan,
                        mixing, packing, quality_rules, repeats, simhash, token_counts)
from svcops.llm.common import read


#: The tokenizers' files; other paths can be given to the operators.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def op1_html_text(spark, sf_dir):
    """Main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages"))


def op2_mixing(spark, sf_dir):
    """Domain posteriors and mixing rate of every document."""
    return mixing.mixed_rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))[0]


def op3_token_counts(spark, sf_dir):
    """Tokens of every document."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"), token_counts.read_vocabulary(TOKENIZER))


def op4_decontaminate(spark, sf_dir):
    """Documents that contain benchmark passages."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark, sf_dir):
    """What remains of every document without passages that start in an earlier one."""
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    """Licence families that documents name."""
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    """Quality score of every document."""
    return quality_rules.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_exact_dedup(spark, sf_dir):
    """Exact copies among all documents."""
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    """Language of every document."""
    return language_id.identify(read(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark, sf_dir):
    """Near-duplicate component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark, sf_dir):
    """Place of every document's pieces in sequences of 1,024 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def op12_token_alignment(spark, sf_dir):
    """Groups and links of every document's tokens by two tokenizers."""
    return alignment.digest(alignment.align(read(spark, sf_dir, "documents"), BYTE_TOKENIZER, TOKENIZER))


def op13_conversation_repair(spark, sf_dir):
    """Faults and cheapest repair of every damaged conversation."""
    return conversations.digest(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_html_text, op2_mixing, op3_token_counts, op4_decontaminate, op5_suffix_dedup, op6_license_scan, op7_quality_rules,
    op8_exact_dedup, op9_language_id, op10_simhash_near_dedup, op11_best_fit_packing, op12_token_alignment,
    op13_conversation_repair)}

SQL = {
    "op8_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm)""",
}
