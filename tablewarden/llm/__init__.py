"""Training-data operators: archives, scoring, packing, language, segmentation, duplicates, toxicity, quality, search, licences."""
