"""Column functions: analysis, citations, statutes, URLs, codecs."""
