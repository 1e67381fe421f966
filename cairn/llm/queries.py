"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import best_fit, block_rules, cross_parse, host_rules, hyper_minhash, skip_chain, sum_squares, tool_links, trigram_index, wu_manber


def queries() -> dict:
    return {
        "op1_tool_links": tool_links.query,
        "op2_trigram_index": trigram_index.query,
        "op3_wu_manber": wu_manber.query,
        "op4_host_rules": host_rules.query,
        "op5_best_fit_matrices": best_fit.query,
        "op6_block_rules": block_rules.query,
        "op7_skip_chain": skip_chain.query,
        "op8_hyper_minhash": hyper_minhash.query,
        "op9_cross_parse": cross_parse.query,
        "op10_sum_of_squares": sum_squares.query,
        "personal_data_base": skip_chain.base_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_tool_links": tool_links.SQL,
        "op2_trigram_index": trigram_index.SQL,
        "op3_wu_manber": wu_manber.SQL,
        "op4_host_rules": host_rules.SQL,
        "op8_hyper_minhash": hyper_minhash.SQL,
        "personal_data_base": skip_chain.BASE_SQL,
    }
