"""pagegrid: table extraction and extraction-quality analytics over OCR pages, on Spark."""
