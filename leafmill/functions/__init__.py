"""Column functions: text, URLs, numbers, arrays and the page event stream."""
