"""shoplens.functions"""
