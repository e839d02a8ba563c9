"""Publishing: views, files and bronze tables, with counts, history and previews."""
