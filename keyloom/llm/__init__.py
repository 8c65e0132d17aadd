"""Operations for preparing training text at scale."""
