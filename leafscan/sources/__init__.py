"""Where pages and words come from: tables, recognised pages (hOCR), plain texts laid out on pages."""
