"""Operations of a training-data pipeline: ten operators over documents, pages and conversations."""
