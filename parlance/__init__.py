"""Spoken-content analytics as Spark DataFrames. The names below are the operators that make up whole analyses."""

from importlib import import_module

_WHERE = {
    "analyze_multimodal": "operators.multimodal:merged",
    "analyze_speakers": "operators.speakers:analysis",
    "analyze_visuals": "operators.visual:analysis",
    "build_knowledge_graph": "operators.graph:build_graph",
    "chunk_transcripts": "operators.retrieval:chunk_transcripts",
    "classify_requests": "streaming.access:classified",
    "detect_chapters_enhanced": "operators.summaries:enhanced_chapters",
    "export_chapter_timestamps": "operators.segments:chapter_list",
    "export_summary_json": "operators.summaries:as_json",
    "export_summary_markdown": "operators.summaries:markdown",
    "extract_entities": "operators.graph:entities",
    "extract_insights": "operators.speech:findings",
    "get_related_topics": "operators.retrieval:related_topics",
    "load_store": "sources.stores:load",
    "query_graph": "operators.graph:query",
    "query_knowledge": "operators.retrieval:query_knowledge",
    "search_insights": "operators.speech:search",
    "segment_content": "operators.segments:topics",
    "settings": "config:settings",
    "store_chunks": "sources.stores:add_chunks",
    "summarize_video": "operators.summaries:summarize",
    "transcribe": "sources.media:transcribed",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    module, _, attr = _WHERE[name].partition(":")
    return getattr(import_module(f"parlance.{module}"), attr)
