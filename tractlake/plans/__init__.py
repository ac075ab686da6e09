"""The four domain recipes, from landed files to gold tables."""
