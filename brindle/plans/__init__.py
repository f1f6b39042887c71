"""From dialect text to Spark SQL text: tokens, syntax tree, rendering."""
