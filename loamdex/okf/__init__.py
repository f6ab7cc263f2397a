"""Knowledge bundles: directories of Markdown documents with YAML metadata, checked, linked and kept in an index."""
