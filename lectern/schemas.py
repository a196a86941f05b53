"""Schemas of papers, passages and results, always given to readers, never inferred."""

PAPER = "arxiv_id string, clean_id string, title string, authors array<string>, published string, categories array<string>, month_stratum string, html_url string, total_words int, block_counts map<string,int>, sections array<struct<section_id:string, heading:string, blocks:array<struct<section_id:string, type:string, content:string>>>>"
PASSAGE = "arxiv_id string, clean_id string, title string, month_stratum string, section_id string, section_path string, block_range array<int>, type string, word_count int, char_count int, section_url string, content string, contextual_content string, oversized boolean, passage_id string"
ENTRY = "arxiv_id string, clean_id string, title string, published string, authors array<string>, categories array<string>, summary string, html_url string, month_stratum string"
SKIPPED = "arxiv_id string, title string, month_stratum string, reason string"
