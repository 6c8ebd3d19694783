"""Table schemas of the graph model."""

from __future__ import annotations

# What a store adds to its rows when it writes them.
STORED: dict[str, str] = {"edges": "effective_reveal int"}

TABLES: dict[str, str] = {
    "works": "work_id long, slug string, title string",
    "chapters": "work_id long, ordinal int, title string, clean_text string, content_hash string, source_path string",
    "chunks": "work_id long, chapter_ordinal int, ordinal int, char_start int, char_end int, text string, content_hash string",
    "mentions": (
        "work_id long, mention_id long, chapter_ordinal int, ordinal int, surface string, type string, subtype string, "
        "char_start int, char_end int, score double, method string, node_id long"
    ),
    "nodes": (
        "work_id long, node_id long, type string, name string, subtype string, importance double, "
        "first_seen_chapter int, revealed_chapter int, method string, evidence string"
    ),
    "edges": (
        "work_id long, edge_id long, source_id long, target_id long, relation string, tier int, "
        "first_seen_chapter int, revealed_chapter int, method string, evidence string"
    ),
    "node_properties": (
        "work_id long, prop_id long, node_id long, key string, value string, first_seen_chapter int, "
        "revealed_chapter int, method string, evidence string"
    ),
}

# Tables beside the model: the ids that entities keep over rebuilds, the vector index, and what streams keep up to date.
INTERNAL: dict[str, str] = {
    "node_ids": "work_id long, type string, norm string, node_id long",
    "vectors": "work_id long, chunk_id long, chapter_ordinal int, char_start int, char_end int, text string, embedding array<double>, cell int",
    "running_entities": "work_id long, entity string, first_seen_chapter int, mentions long",
    "chapter_entities": "work_id long, chapter_ordinal int, node_id long, mentions long",
    "chapter_pairs": "work_id long, chapter_ordinal int, lo long, hi long, cooccurrences long",
    "centroids": "work_id long, cell int, visits int, centroid array<double>",
}
