"""Documents as tables: Markdown trees with frontmatter, parsed, checked, linked and changed on Spark."""
