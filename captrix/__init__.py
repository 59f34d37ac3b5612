"""captrix: timed text (captions, subtitles, lyrics, transcripts) as Spark tables.

One file is an ordered relation of cues; many files are one ``cues`` table keyed by ``file_id`` and ordered by ``pos``.
"""

__version__ = "0.1.0"
